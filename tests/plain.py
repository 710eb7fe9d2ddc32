"""Plain versions that look at everything, to hold the engine against."""

import math
from collections import Counter

import numpy as np

from memoryloom.operators.revise import composed, merged_card, relation, tokens
from memoryloom.params import DEFAULT


def bm25(docs, query, params=DEFAULT):
    tfs = [Counter(d) for d in docs]
    lengths = [tf.total() for tf in tfs]
    n, total = len(docs), sum(lengths)
    scores = np.zeros(n)
    if not total:
        return scores
    df = Counter(t for tf in tfs for t in tf)
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    floor = params.epsilon * sum(idf.values()) / len(idf)
    for i, (tf, length) in enumerate(zip(tfs, lengths, strict=True)):
        for t, q in Counter(query).items():
            if tf[t]:
                scores[i] += q * (floor if idf[t] < 0 else idf[t]) * tf[t] * (params.k1 + 1) / (tf[t] + params.k1 * (1 - params.b + params.b * length / (total / n)))
    return scores


def cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float(a @ b / ((np.linalg.norm(a) + 1e-12) * (np.linalg.norm(b) + 1e-12)))


def nearest(content, embedding, notes, params=DEFAULT):
    if not notes:
        return None
    docs = [tokens(n["content"]) for n in notes]
    raw = bm25(docs, tokens(content), params)
    raw -= raw.min()
    lexical = raw / raw.max() if raw.max() > 1e-9 else np.array([float(bool(set(tokens(content)) & set(d))) for d in docs])
    best = np.maximum(lexical, [cosine(embedding, n["embedding"]) for n in notes])
    best = np.round(best, 9)
    return notes[int(best.argmax())] if best.max() >= params.revision_sim_threshold else None


def fold(stored, candidates, judge=None, params=DEFAULT):
    """(action, id, candidate_id, version, content) decided for one user's candidates in order."""
    notes, out, request = sorted(stored, key=lambda n: n["id"])[: params.dedup_neighbor_cap], [], None
    for c in candidates:
        if c["request_id"] != request:
            request, notes = c["request_id"], notes[: params.dedup_neighbor_cap]
        same = next((n for n in notes if n["content"] == c["content"]), None)
        target = same or nearest(c["content"], c["embedding"], notes, params)
        found = "duplicate" if same else None if target is None else judge(c["content"], target["content"])[0] if judge else relation(c["content"], target["content"])
        action = {"duplicate": "SKIP", "supports": "MERGE", "refines": "MERGE", "contradicts": "SUPERSEDE"}.get(found, "INSERT")
        note = c | {"version": 1}
        if action == "MERGE":
            card = merged_card(target["card"], c["card"], {}, found == "refines")
            note = target | {"card": card, "content": composed(card) or target["content"], "version": target["version"] + 1}
        elif action == "SUPERSEDE":
            note = c | {"version": target["version"] + 1}
            out.append(("RETIRE", target["id"], None, target["version"], target["content"]))
        if action in ("MERGE", "SUPERSEDE"):
            notes = [n for n in notes if n["id"] != target["id"]]
        if action != "SKIP":
            notes.insert(0, note)
        out.append((action, note["id"], c["id"], note["version"], note["content"]))
    return out
