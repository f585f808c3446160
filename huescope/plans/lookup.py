"""Index lookup: captures and a domain list to index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from huescope.operators import captures as ops
from huescope.sources.shared import materialised


def lookup_homepages(captures: DataFrame, domains: DataFrame, crawl: str, long_list: bool = False) -> DataFrame:
    """Index rows of every listed domain, found or not.

    ``long_list`` says that the list is too long to broadcast: homepages are then
    picked first, and one row per domain meets the list in a shuffle join.

    The found rows, one per domain at most, are written before they are
    completed: both the result and the search for missing domains read them,
    and the index itself must be scanned only once.
    """
    homepages = ops.filter_homepage_captures(captures, crawl)
    if long_list:
        picked = ops.filter_domain_in(ops.pick_homepage(homepages), domains.hint("merge"))
    else:
        picked = ops.pick_homepage(ops.filter_domain_in(homepages, domains))
    found = ops.normalise_captures(ops.project_captures(picked))
    return ops.mark_not_found(materialised(found), domains)


def import_captures(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Index rows from an exported lookup result."""
    return ops.mark_not_found(ops.normalise_captures(rows), domains)
