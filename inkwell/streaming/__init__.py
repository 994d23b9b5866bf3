"""inkwell.streaming"""
