"""Queries of rows from markup and of text pieces."""

from __future__ import annotations

from siftkite.operators import markup as M
from siftkite.plans.registry import query


@query("page_rows")
def _(t):
    return M.html_rows(t.pages)


@query("embedding_pieces")
def _(t):
    return M.packed_sentences(t.documents)
