"""Pseudonymization of Italian legal documents on Spark, and operators for training data."""

__version__ = "0.2.0"
_SURFACE = {
    "Config": "config", "Lexicons": "functions.lexicons", "analyze": "plans.pseudonymize", "render": "plans.pseudonymize", "pseudonymize": "plans.pseudonymize",
    "anonymize": "plans.pseudonymize", "run_batch": "sources.batch",
}


def __getattr__(name: str):
    """The surface, loaded when it is asked for: Spark is not imported before."""
    if name not in _SURFACE:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_SURFACE[name]}"), "run" if name == "run_batch" else name)
