"""Training-data operators: each module is one operator; ``queries`` registers them.

Nothing outside this package imports it.
"""
