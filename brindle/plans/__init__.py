"""Named queries over the tables of a data folder; importing this registers them."""

from brindle.plans import boards, choosing, curating, extracting, listings, nearing, recalculating, repeats, resolving, scoring, searching, storing, upkeep  # noqa: F401
