"""Operators that prepare text for training: each module holds one, `queries` registers them."""
