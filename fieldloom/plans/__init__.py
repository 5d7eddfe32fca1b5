"""Pipelines: operations recorded as a graph and run later."""

from .pipeline import Pipeline, create_pipeline

__all__ = ["Pipeline", "create_pipeline"]
