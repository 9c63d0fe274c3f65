"""Brute-force versions that several tests share."""


def near_brute(texts):
    """The smallest id that each text reaches over pairs whose sets of five-word shingles have a similarity of 0.8 or more."""
    sets = {}
    for k, t in texts.items():
        w = [x.lower() for x in (t or "").split()]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}
    keys, group = sorted(sets), {k: k for k in sets}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if group[a] != group[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group
