"""marketloom.sources"""
