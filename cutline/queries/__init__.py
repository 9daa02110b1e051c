"""All registered queries, one module per inventory section."""

from importlib import import_module

MODULES = ("scans", "projections", "joins", "aggregates", "windows", "sorts", "text", "rules", "evaluation", "models", "composites")


def load_all():
    from . import base
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return base.QUERIES, base.ORACLES
