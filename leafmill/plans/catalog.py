"""All registered queries of the book domain, and their SQL twins."""

from __future__ import annotations

from ..streaming.replay import STREAMS
from .oracle import SQL
from .oracle_records import RECORDS_SQL
from .oracle_streams import STREAM_SQL
from .oracle_text import TEXT_SQL
from .queries import QUERIES
from .records import RECORDS

BOOK = QUERIES | RECORDS | STREAMS
TWINS = SQL | TEXT_SQL | RECORDS_SQL | STREAM_SQL
