"""maskwright.streaming"""
