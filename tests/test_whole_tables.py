"""Every registered SQL text reads whole tables: no prefix of frames or ids, and a cap on rows only where a top-k share is the feature."""

import re

import pytest

from driftline.plans import catalog, catalog_audit, catalog_extra, catalog_fields, catalog_links, catalog_more, catalog_summary  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_no_prefix(name):
    capped = r"" if name == "error_concentration" else r"|\bLIMIT\b"
    assert not re.search(rf"(frame|_id) *< *\d|USING SAMPLE{capped}", catalog.SQL[name])
