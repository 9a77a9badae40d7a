import importlib


def load_all():
    """Import every query module and return the registry."""
    from slidemesh.plans import registry
    for m in MODULES:
        importlib.import_module(f"slidemesh.plans.{m}")
    return registry


MODULES = ["deck_queries", "text_queries", "eval_queries", "track_queries", "training_queries", "mask_queries", "source_queries"]
