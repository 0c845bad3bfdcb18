"""What several test modules use."""


def rows_by_text(spark, sf):
    """(doc_id, text) of documents in order."""
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def brute_components(docs):
    """doc_id to (set size, least reachable doc_id) by comparing every pair; docs: (doc_id, text)."""
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}
