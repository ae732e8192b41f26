"""Operators for building language-model training data from tables of documents.

Every operator takes DataFrames and returns one. Columns beyond those an operator
names are ignored, whatever they are called.
"""
