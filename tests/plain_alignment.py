"""Resolution of one sentence in plain Python, against which the array program is tested."""


def connect(places: list[list[int]], out: dict[int, set[int]], sources: set[int], sinks: set[int]) -> list[int]:
    """The path through one candidate of each place, or none."""
    if not places:
        return []
    reached: list[dict[int, int]] = [{n: -1 for n in sorted(set(places[0])) if n in sources}]
    for here in places[1:]:
        before = sorted(reached[-1])
        now: dict[int, int] = {}
        for n in sorted(set(here)):
            back = next((p for p in before if n in out.get(p, ())), None)
            if back is not None:
                now[n] = back
        reached.append(now)
    ends = [n for n in reached[-1] if n in sinks]
    if not ends:
        return []
    path = [min(ends)]
    for step in reversed(reached[1:]):
        path.append(step[path[-1]])
    return path[::-1]


def resolve_one(exact: list[list[int]], variant: list[list[int]], nodes: dict[int, tuple], edges: list[tuple[int, int]]) -> tuple[str, list[int], int, int]:
    """(pass, path, redirected places, widened places); pass none and no path if nothing resolves."""
    out: dict[int, set[int]] = {}
    has_in = set()
    for u, v in edges:
        out.setdefault(u, set()).add(v)
        has_in.add(v)
    sources, sinks = {n for n in nodes if n not in has_in}, {n for n in nodes if n not in out}
    wired = has_in | set(out)
    by_surface: dict[tuple, list[int]] = {}
    for n in sorted(wired & set(nodes)):
        by_surface.setdefault(nodes[n], []).append(n)
    if all(exact) and (path := connect(exact, out, sources, sinks)):
        return "exact", path, 0, 0
    redirected, places = 0, []
    for here in variant:
        if here and wired.isdisjoint(here):
            twins = sorted({t for n in here for t in by_surface.get(nodes.get(n), ())})
            if twins:
                redirected, here = redirected + 1, twins
        places.append(here)
    if all(places) and (path := connect(places, out, sources, sinks)):
        return "variant", path, redirected, 0
    widened, wide = 0, []
    for here in places:
        more = sorted({t for n in here for t in by_surface.get(nodes.get(n), ())} | set(here))
        widened += len(more) > len(set(here))
        wide.append(more)
    if all(wide) and (path := connect(wide, out, sources, sinks)):
        return "widened", path, redirected, widened
    return "none", [], redirected, widened
