"""inkwell.functions"""
