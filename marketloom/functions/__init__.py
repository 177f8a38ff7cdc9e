"""marketloom.functions"""
