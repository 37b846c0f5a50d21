from itertools import zip_longest


def differ(a, b):
    """The first few places where two lists differ; pytest's own report of long lists takes minutes."""
    return [f"{x!r:.300} | {y!r:.300}" for x, y in zip_longest(a, b) if x != y][:3]
