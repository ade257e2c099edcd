"""Relational and ordered-sequence operators: DataFrame in, lazy DataFrame out."""
