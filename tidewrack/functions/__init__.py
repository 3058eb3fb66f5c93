"""Scalar functions: Column to Column, without UDFs except where a module says so."""
