"""The stemmer on words whose stems are published, and over a table."""

import pytest

from postquill.functions.stemming import stem, stemmed_texts
from postquill.operators.lexical import terms

PAIRS = (
    "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist "
    "consolation consol console consol consolidate consolid consolingly consol knack knack knackeries knackeri knaves knave knavish knavish kneaded knead kneel kneel knightly knight "
    "knock knock knots knot generally general communication communic happy happi hoped hope hopping hop ties tie cries cri gas gas this this kiwis kiwi skies sky dying die "
    "luxuriated luxuri hopping hop falling fall agreed agre relational relat conditional condit rational ration vietnamization vietnam predication predic operator oper sensibiliti sensibl "
    "triplicate triplic formative format electrical electr hopefulness hope adjustment adjust adoption adopt controlling control roll roll probate probat cease ceas news news proceed proceed"
).split()


@pytest.mark.parametrize(("word", "want"), list(zip(PAIRS[::2], PAIRS[1::2])))
def test_stem(word, want):
    assert stem(word) == want


def test_stemmed_texts(spark):
    t = spark.createDataFrame([("a", "Consigned and consigning consignments"), ("b", None)], "id string, text string")
    assert {r["id"]: r["text"] for r in stemmed_texts(t, terms).collect()} == {"a": "consign consign consign", "b": ""}
