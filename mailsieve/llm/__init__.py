"""Operators of a training-data pipeline; each module builds one by the method in its docstring."""
