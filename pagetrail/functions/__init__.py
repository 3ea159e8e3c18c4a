"""Scalar functions: Column -> Column, plus the one Arrow-batched HTML parser."""
