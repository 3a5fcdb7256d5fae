"""Operators over DataFrames: everything here is lazy unless its docstring says otherwise."""
