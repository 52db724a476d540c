"""postquill.functions"""
