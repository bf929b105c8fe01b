"""Table layouts of the engine.

An absent edge in a criterion is a NULL weight, an unreachable target a NULL cost; vertex
ids are 0-based. Graphs are undirected: `edges` holds both directions.
"""

from __future__ import annotations

EDGES = "src long, dst long, weights array<int>"
EDGES_LONG = "cri int, src long, dst long, w long"
PARTITIONS = "v long, pid int, pos long"
BOUNDARY = "v long, pid int, tag tinyint"
SHORTCUTS = "pid int, src long, dst long, weights array<long>"
OD_PAIRS = "query_id long, qtype string, s long, t long"
RESULT = "query_id long, cri int, cost long"

#: Fixed values of the text and binary formats: an edge missing in a criterion, an unreachable target.
MISSING_WEIGHT = 1_000_000
UNREACHABLE = 2_147_483_647
#: Bytes of a packed edge, of a partition by default, and integers in an I/O block.
EDGE_BYTES = 28
PARTITION_KB = 256
BLOCK_INTS = 65_536
CRITERIA_NAMES = ("Distance", "Time", "Correlated", "Anti", "Independent")
