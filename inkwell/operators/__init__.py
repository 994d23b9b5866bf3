"""inkwell.operators"""
