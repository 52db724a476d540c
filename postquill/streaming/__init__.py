"""postquill.streaming"""
