"""Message trees: order of nodes, active path and nearest ancestors, one conversation at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = "conversation_id string, node_id string, position long, depth long, on_active_path boolean, message_ancestor string"


def _walk(nodes: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one conversation in pre-order; children by their order, nodes that no root reaches after all others, by id."""
    ids = nodes["node_id"].tolist()
    parent = dict(zip(ids, (p if isinstance(p, str) else None for p in nodes["parent_id"])))
    has_message = dict(zip(ids, nodes["has_message"]))
    children: dict = {}
    for node, _ in sorted(zip(ids, nodes["child_order"]), key=lambda x: (x[1], x[0])):
        children.setdefault(parent[node], []).append(node)
    roots = [n for n in sorted(ids) if parent[n] is None or parent[n] not in parent]
    depth: dict[str, int] = {}
    order: list[str] = []
    for start in [*roots, *sorted(ids)]:
        stack = [(start, 0)]
        while stack:
            node, d = stack.pop()
            if node in depth:
                continue
            depth[node] = d
            order.append(node)
            stack.extend((c, d + 1) for c in reversed(children.get(node, [])))
    active: set[str] = set()
    node = nodes["current_node"].iloc[0]
    while node in parent and node not in active:
        active.add(node)
        node = parent[node]
    ancestor: dict = {}
    for node in order:
        up, seen = parent[node], {node}
        while up in parent and up not in seen and not has_message[up]:
            seen.add(up)
            up = parent[up]
        ancestor[node] = up if up in parent and up not in seen else None
    return pd.DataFrame({"conversation_id": nodes["conversation_id"].iloc[0], "node_id": order, "position": range(len(order)),
                         "depth": [depth[n] for n in order], "on_active_path": [n in active for n in order], "message_ancestor": [ancestor[n] for n in order]})


def walk(nodes: DataFrame) -> DataFrame:
    """(conversation_id, node_id, position, depth, on_active_path, message_ancestor) of nodes
    (conversation_id, node_id, parent_id, child_order, has_message, current_node).

    Cycles end where a node repeats.  A group is one conversation's tree, a single document of the export.
    """
    return nodes.groupBy("conversation_id").applyInPandas(_walk, COLUMNS)
