"""Roles over the driver tables and the registered queries."""

import importlib

MODULES: list[str] = ["speaker_queries", "quality_queries", "repair_queries", "catalog_queries", "text_queries", "registry_queries", "interval_queries", "detection_queries", "entity_queries", "source_queries", "stream_queries", "commentary_queries", "tail_queries", "frame_queries", "caption_queries"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"cueloom.plans.{name}")
