"""All bound queries by name."""

from __future__ import annotations

from stayline.bindings import Bound, artifacts, clinical, cohorts, contracts, effects, judgements, outcomes, texts, timelines


def all_bound() -> dict[str, Bound]:
    out: dict[str, Bound] = {}
    for module in (cohorts, timelines, outcomes, judgements, texts, effects, contracts, artifacts, clinical):
        for name, bound in module.QUERIES.items():
            if name in out:
                raise KeyError(f"query {name} is registered twice")
            out[name] = bound
    return out
