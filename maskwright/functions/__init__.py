"""maskwright.functions"""
