"""postquill.plans"""
