"""All registered queries of the ordered-data operators and their SQL oracles."""

from __future__ import annotations

from orderly.plans import q_aggs, q_frames, q_io, q_joins, q_seq, q_text  # noqa: F401
from orderly.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
