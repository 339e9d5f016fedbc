"""corpuslens: source-tree and text-corpus analytics as plain Spark jobs."""

from corpuslens.session import cut, scratch_path, tune

__all__ = ["cut", "scratch_path", "tune"]
