import json
import random

from loomspan.operators import comparison

MESSAGES = "conversation_id string, message_id string, platform_message_id string, sequence long, role string, parent_message_id string, branch_id string, representations map<string,string>, blocks map<string,string>, " \
    "attachments string, citations string, artifacts string, tool_events string"
CAPTURES = "conversation_id string, platform string, account string, status string, branches array<struct<status string, branch_sha256 string, message_id string>>"
NAMES = [x.split(" ")[0] for x in MESSAGES.split(", ")]


def sign(m):
    return json.dumps([m["role"], m["parent_message_id"], m["branch_id"], sorted(m["representations"].items()), sorted(m["blocks"].values())])


def classify(a, b):
    pairs = [("role", "role_changed", "metadata"), ("sequence", "sequence_changed", "metadata"), ("parent_message_id", "parent_relationship_changed", "branch"), ("branch_id", "branch_relationship_changed", "branch")]
    found = [(r, d) for c, r, d in pairs if a[c] != b[c]]
    for kind in sorted(a["representations"].keys() | b["representations"].keys()):
        if a["representations"].get(kind) != b["representations"].get(kind):
            found.append((kind + "_changed", "rendered_structure" if kind == "sanitized_html" else "text"))
    found += [("content_blocks_changed", "content_blocks")] if a["blocks"] != b["blocks"] else []
    found += [(f"{c}_changed", c) for c in ("attachments", "citations", "artifacts", "tool_events") if a[c] != b[c]]
    if not found:
        return "unchanged", ("all_preserved_hashes_and_relationships_match",), ()
    dimensions = tuple(dict.fromkeys(d for _, d in found))
    return next((c for d, c in comparison.PRIMARY if d in dimensions), "metadata_changed"), tuple(r for r, _ in found), dimensions


def brute_force(prior, current, a, b):
    """Message by message, in order; prior and current are lists of dicts by sequence."""
    eligible = a[1:4] == b[1:4] and a[3] == "complete"
    warned = not eligible or any(x[0] != "captured" for x in a[4] + b[4])
    records, old, new = [], list(prior), list(current)

    def groups(ms, key):
        out = {}
        for m in ms:
            if key(m):
                out.setdefault(key(m), []).append(m)
        return out

    for key, method in ((lambda m: m["platform_message_id"], "platform_message_id"), (lambda m: m["message_id"], "canonical_message_id"), (sign, "exact_hash_context")):
        left, right = groups(old, key), groups(new, key)
        for k, ms in left.items():
            if len(ms) == 1 and len(right.get(k, [])) == 1:
                x, y = ms[0], right[k][0]
                old, new = [m for m in old if m is not x], [m for m in new if m is not y]
                records.append((*classify(x, y), x["message_id"], y["message_id"], method, "exact"))
    for y in [m for m in new if m["role"] == "assistant" and m["branch_id"]]:
        found = [x for x in old if x["role"] == "assistant" and x["branch_id"] and x["parent_message_id"] == y["parent_message_id"]]
        if len(found) == 1:
            old, new = [m for m in old if m is not found[0]], [m for m in new if m is not y]
            records.append(("regenerated", ("assistant_alternative_same_parent_with_branch_evidence",), ("text", "branch"), found[0]["message_id"], y["message_id"], "branch_parent", "conservative"))
    known, tail = {m["message_id"] for m in prior + current}, max([m["sequence"] for m in prior], default=-1)
    for y in new:
        if sum(sign(x) == sign(y) for x in old) > 1:
            told = "uncertain", ("ambiguous_fallback_candidates",), ()
        elif y["branch_id"]:
            told = "branched", ("new_message_on_captured_branch",), ("branch",)
        elif eligible and y["sequence"] > tail and (not y["parent_message_id"] or y["parent_message_id"] in known):
            told = "appended", ("new_message_after_prior_active_path_tail",), ()
        else:
            told = "uncertain", ("unmatched_current_message",), ()
        records.append((*told, None, y["message_id"], "none", "uncertain" if told[0] == "uncertain" else "conservative"))
    certain = not warned and not any(r[0] == "uncertain" for r in records)
    for x in old:
        records.append((("removed_from_active_path", ("absent_from_new_verified_active_path",)) if certain else ("uncertain", ("absence_not_confirmed_due_to_incomplete_evidence",)))
                       + ((), x["message_id"], None, "none", "conservative" if certain else "uncertain"))
    known_branches = {x[1] for x in a[4]}
    records += [("branched", ("branch_graph_changed",), ("branch",), None, x[2], "none", "conservative") for x in b[4] if x[1] not in known_branches]
    return sorted(records, key=repr)


def versions(rng, c):
    prior = []
    for i in range(rng.randrange(0, 9)):
        prior.append(dict(zip(NAMES, (c, f"m{i}", rng.choice([None, "", f"p{i}", f"p{i}", f"p{rng.randrange(4)}"]), i, rng.choice(["user", "assistant"]), rng.choice([None, f"m{max(0, i - 1)}"]),
                                      rng.choice([None, None, "b"]), {"canonical_text": f"t{rng.randrange(3)}", "sanitized_html": "h"}, {"x": f"s{rng.randrange(2)}"}, "a", "c", "f", "o"))))
    current = []
    for m in prior:
        m = dict(m)
        if rng.random() < 0.15:
            continue
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.choice(NAMES[1:])
            m[at] = {"message_id": f"n{rng.randrange(99)}{m['message_id']}", "platform_message_id": None, "sequence": m["sequence"] + 1, "role": "assistant", "parent_message_id": "m0", "branch_id": rng.choice(["b", "d", None]),
                     "representations": rng.choice([{"canonical_text": "t9", "sanitized_html": "h"}, {"canonical_text": m["representations"]["canonical_text"]}, {"canonical_text": "t9"}]), "blocks": {"x": "s9"}}.get(at, "new")
        current.append(m)
    for i in range(rng.choice([0, 0, 1, 2])):
        current.append(dict(zip(NAMES, (c, f"new{i}", None, 20 + i, "assistant", rng.choice([None, "m0", "gone"]), rng.choice([None, "b"]), {"canonical_text": f"t{rng.randrange(3)}", "sanitized_html": "h"}, {"x": "s0"}, "a", "c", "f", "o"))))
    current.sort(key=lambda m: (m["sequence"], m["message_id"]))

    def capture(extra):
        return (c, "web", rng.choice(["me"] * 9 + ["you"]), rng.choice(["complete"] * 9 + ["partial"]), [(rng.choice(["captured"] * 9 + ["partial"]), f"h{i}", "m0") for i in range(rng.choice([0, 1]) + extra)])

    return prior, current, capture(0), capture(rng.choice([0, 0, 1]))


def test_records_equal_a_walk_over_the_messages(spark):
    rng = random.Random(12)
    cases = {f"c{i}": versions(rng, f"c{i}") for i in range(250)}
    tables = [spark.createDataFrame([tuple(m.values()) for v in cases.values() for m in v[side]], MESSAGES) for side in (0, 1)]
    captures = [spark.createDataFrame([v[side] for v in cases.values()], CAPTURES) for side in (2, 3)]
    records = comparison.compare(*tables, *captures)
    found = {c: [] for c in cases}
    for r in records.collect():
        found[r.conversation_id].append((r.classification, tuple(r.reasons), tuple(r.dimensions), r.prior_message_id, r.current_message_id, r.match_method, r.confidence))
    seen = set()
    for c, v in cases.items():
        assert sorted(found[c], key=repr) == brute_force(*v), c
        seen |= {r[0] for r in found[c]}
    assert seen == set(comparison.CLASSES)
    for r in comparison.summary(records, comparison.inputs(*captures)).collect():
        assert sum(r[f"n_{c}"] for c in comparison.CLASSES) == len(found[r.conversation_id])
        assert (r.status == "complete") == (not r.warnings and not r.n_uncertain)
