"""maskwright.plans"""
