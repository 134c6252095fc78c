"""Every query of the library, except those of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.functions import strings
from weftline.operators import captions, detect, document, features, masks, pageset, predict, provenance, receipts, relational, samples, signal, tabular, timeline, typeset
from weftline.plans import limits, planner
from weftline.sources import archives, dxf, files, images, office, sink, splits
from weftline.streaming import journal

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (detect, planner, timeline, pageset, predict, provenance, strings, tabular, signal, document, archives, office, journal, relational, limits, captions, images, files, receipts, features, dxf, samples, splits, sink, typeset, masks)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
