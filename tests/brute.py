"""Plain numpy versions of the distributed operators, for small inputs."""

import numpy as np

EARTH_KM = 6371.0


def haversine(lat1, lon1, lat2, lon2, radius=EARTH_KM):
    lat1, lon1, lat2, lon2 = (np.radians(v) for v in (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(
        (lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def dbscan(distance, min_points, weights=None):
    """Labels and core flags by the usual visiting order."""
    n = len(distance[0])
    weights = np.ones(n) if weights is None else weights
    near = distance[0] <= distance[1]
    core = (near * weights).sum(axis=1) >= min_points
    labels = np.full(n, -1)
    current = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        labels[i] = current
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for k in np.flatnonzero(near[j]):
                if labels[k] == -1:
                    labels[k] = current
                    stack.append(k)
        current += 1
    return labels, core
