"""All queries over the security domain, by name, and the SQL that must give the same rows."""

from . import content, desk, kept, more, network, streams

#: Each of these modules registers its queries in the same two tables when it is loaded.
MODULES = (desk, content, more, streams, kept, network)
QUERIES: dict = dict(desk.QUERIES)
ORACLES: dict = dict(desk.ORACLES)
