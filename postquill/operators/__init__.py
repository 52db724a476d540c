"""postquill.operators"""
