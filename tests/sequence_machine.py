"""One machine that sees every edge in order: what the joins of the library are held against."""

from __future__ import annotations

from typing import Any

from provspark.operators.rules import WINDOW_S, sequences


class SequenceMachine:
    """The live partial matches of sequence rules over edges in order.

    A partial is keyed by (rule, root); its active subject moves to the object
    of an advancing edge where that is a process. It dies when more than the
    rule's window passes since its last advance, fires and ends at the last
    step, and a new one starts at a first step if none is live. One edge may
    advance and start. Partials are found by (rule, active subject).
    """

    def __init__(self, rules: list[dict[str, Any]]):
        self.rules = sequences(rules)
        self.steps = [len(r["steps"]) for r in self.rules]
        self.window = [(r.get("window") or WINDOW_S) * 1_000_000_000 for r in self.rules]
        self.live: dict[tuple[int, str], dict[str, Any]] = {}
        self.at: dict[tuple[int, str], dict[str, None]] = {}

    def _drop(self, rule: int, root: str) -> None:
        s = self.live.pop((rule, root))
        roots = self.at[rule, s["active"]]
        del roots[root]
        if not roots:
            del self.at[rule, s["active"]]

    def expire(self, ts: int) -> None:
        """Forget what can no longer advance; only memory depends on it."""
        for rule, root in [k for k, s in self.live.items() if ts - s["last"] > self.window[k[0]]]:
            self._drop(rule, root)

    def feed(self, rule: int, mask: int, e: Any) -> list[dict[str, Any]]:
        """Firings of one rule that edge ``e`` completes; bit k of ``mask`` says that it can serve step k."""
        fired = []
        active = e.dst_id if e.dst_type == "PROCESS" else e.src_id
        for root in list(self.at.get((rule, e.src_id), ())):
            s = self.live[rule, root]
            if e.ts - s["last"] > self.window[rule]:
                self._drop(rule, root)
            elif mask >> s["step"] & 1:
                events, nodes = [*s["events"], e.event_id], [*s["nodes"], e.src_id, e.dst_id]
                step = s["step"] + 1
                self._drop(rule, root)
                if step == self.steps[rule]:
                    fired.append({
                        "rule_id": self.rules[rule]["id"], "root": root, "fired_at": e.ts, "last_event_id": e.event_id, "endpoint_id": e.endpoint_id,
                        "subject_name": e.src_name, "event_ids": events, "node_ids": list(dict.fromkeys(nodes)),
                    })
                else:
                    self._keep(rule, root, step, e.ts, active, events, nodes)
        if mask & 1:
            old = self.live.get((rule, e.src_id))
            if old is not None and e.ts - old["last"] > self.window[rule]:
                self._drop(rule, e.src_id)
                old = None
            if old is None:
                self._keep(rule, e.src_id, 1, e.ts, active, [e.event_id], [e.src_id, e.dst_id])
        return fired

    def _keep(self, rule: int, root: str, step: int, ts: int, active: str, events: list[str], nodes: list[str]) -> None:
        self.live[rule, root] = {"step": step, "last": ts, "active": active, "events": events, "nodes": nodes}
        self.at.setdefault((rule, active), {})[root] = None
