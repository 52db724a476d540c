"""postquill.sources"""
