"""The queries the driver runs, over views of the given tables."""

from importlib import import_module

MODULES = (
    "text_queries",
    "source_queries",
    "state_queries",
    "discovery_queries",
    "streaming_queries",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"contract.{name}")
