"""Policies as data: which sources, which handlers, which window; resolved into metric tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..operators.merging import union_sources
from ..operators.periods import clamp_periods, retain
from .handlers import HANDLERS, Dimensions, Options

#: Handlers a user adds: name → function of (events, options) that returns the long form.
_added: dict[str, Callable] = {}


class PolicyError(ValueError):
    """A policy that can't be planned."""


@dataclass
class HandlerSpec:
    type: str
    options: dict = field(default_factory=dict)  # filters, deep_sample_rate, topn_count, enable, disable


@dataclass
class Policy:
    """``window`` overrides what handlers set (num_periods, deep_sample_rate, topn_count, topn_percentile_threshold)."""

    name: str
    handlers: Sequence[HandlerSpec]
    window: dict = field(default_factory=dict)
    origin: str = "epoch"
    mode: str = "exact"


def register_handler(name: str, fn: Callable) -> None:
    _added[name] = fn


def coerce(value: str) -> object:
    """A configuration scalar: digits are a number, true and false (in any case) booleans, else text."""
    if value.isdigit():
        return int(value)
    return {"true": True, "false": False}.get(value.lower(), value)


def _options(policy: Policy, spec: HandlerSpec, by_tap: bool) -> Options:
    merged = {**spec.options, **policy.window}
    known = {k: merged.pop(k) for k in ("deep_sample_rate", "num_periods", "topn_count", "topn_percentile_threshold", "enable", "disable") if k in merged}
    if not 1 <= clamp_periods(known.get("num_periods")) <= 10:
        raise PolicyError("num_periods is 1 to 10")
    return replace(Options(policy=policy.name, origin=policy.origin, mode=policy.mode, filters=merged, dims=["tap"] if by_tap else []), **known)


def run_policy(policy: Policy, taps: dict[str, dict[str, DataFrame]], dimensions: Dimensions | None = None, by_tap: bool = False) -> DataFrame:
    """All metrics of a policy over its taps (tap → event family → table), the newest ``num_periods`` periods.

    One plan reads each family once for all taps; with ``by_tap`` every metric carries the tap's label.
    """
    if not policy.handlers:
        raise PolicyError(f"policy {policy.name} has no handlers")
    out = None
    for spec in policy.handlers:
        fn = _added.get(spec.type) or HANDLERS.get(spec.type)
        if fn is None:
            raise PolicyError(f"unknown handler type {spec.type}; valid types: {', '.join(sorted({*HANDLERS, *_added}))}")
        o = _options(policy, spec, by_tap)
        family = {"net": "packets", "net_v1": "packets", "dns": "dns", "dns_v1": "dns", "flow": "flow_exports", "pcap": "capture_stats", "netprobe": "probes"}.get(spec.type, spec.type)
        events = union_sources({t: tables[family] for t, tables in taps.items() if family in tables})
        m = fn(events, o, dimensions) if spec.type in ("net", "net_v1", "dns", "dns_v1", "flow") else fn(events, o)
        m = retain(m, o.num_periods, keys=["policy", "handler"])
        out = m if out is None else out.unionByName(m)
    return out
