"""Plain single-machine versions of the clustering steps, for small fixtures."""

import numpy as np


def mutual_reachability(vectors, min_samples):
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(-1))
    k = min(min_samples, len(vectors) - 1)
    core = np.sort(d, axis=1)[:, k].round(9)
    return np.maximum(np.maximum(d.round(9), core[:, None]), core[None])


def spanning_tree(ids, vectors, min_samples):
    """Kruskal over all pairs, edges ordered by weight and both ids."""
    m = mutual_reachability(vectors, min_samples)
    n = len(ids)
    pairs = sorted(
        (m[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(n) for j in range(i)
    )
    group = {i: {i} for i in ids}
    tree = []
    for w, a, b in pairs:
        if group[a] is not group[b]:
            merged = group[a] | group[b]
            for i in merged:
                group[i] = merged
            tree.append((w, a, b))
    return tree


def density_labels(ids, tree, min_cluster_size):
    """Condensed tree by cutting the dearest edge of each part, then excess of mass."""
    clusters = {}

    def parts(nodes, edges):
        left = {next(iter(edges[-1][1:2]))}
        rest = edges[:-1]
        grown = True
        while grown:
            grown = False
            for _, a, b in rest:
                if (a in left) != (b in left):
                    left |= {a, b}
                    grown = True
        right = nodes - left
        return [(s, [e for e in rest if e[1] in s]) for s in (left, right)]

    def walk(nodes, edges, name, born):
        mass, alive = 0.0, (set(nodes), edges)
        members = set(nodes)
        children = []
        while True:
            nodes, edges = alive
            if not edges:
                break
            lam = 1 / max(edges[-1][0], 1e-10)
            sides = parts(nodes, edges)
            big = [s for s in sides if len(s[0]) >= min_cluster_size]
            if len(big) == 2:
                mass += len(nodes) * (lam - born)
                children = [walk(*s, f"{name}{i}", lam) for i, s in enumerate(big)]
                break
            if not big:
                mass += len(nodes) * (lam - born)
                break
            gone = len(nodes) - len(big[0][0])
            mass += gone * (lam - born)
            alive = big[0]
        clusters[name] = dict(mass=mass, members=members, children=[c for c in children])
        return name

    if len(ids) < min_cluster_size or not tree:
        return {i: -1 for i in ids}
    walk(set(ids), sorted(tree), "r", 0.0)
    selected = {}

    def choose(name):
        c = clusters[name]
        below = sum(choose(k) for k in c["children"])
        if name != "r" and c["mass"] >= below:
            for other in [k for k in selected if k.startswith(name)]:
                del selected[other]
            selected[name] = c["members"]
            return c["mass"]
        return max(below, c["mass"])

    choose("r")
    ordered = sorted(selected.values(), key=lambda m: (-len(m), min(m)))
    labels = {i: -1 for i in ids}
    for number, member_ids in enumerate(ordered):
        for i in member_ids:
            labels[i] = number
    return labels
