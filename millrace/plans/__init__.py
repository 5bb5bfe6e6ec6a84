"""Declarative specs and worked compositions of operators."""
