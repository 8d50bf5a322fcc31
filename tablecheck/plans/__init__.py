"""Physical choices: how keys are profiled, joined, paired and spread over tasks.

Frames here use positional names, ``k0 k1 ...`` for keys and ``v0 v1 ...`` for values, so
that no user column name can clash with a working column.
"""
