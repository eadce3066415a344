"""Dynamics features of each arriving step from keyed state, in constant work per step.

A run keeps a ring of its last steps, a few marks (when something last happened) and counts; what grows
with the run (entropies of earlier prefixes, counts of commands, observations and errors) lies in map
state and is touched by key.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from difflib import SequenceMatcher
from functools import lru_cache

from trailcast.functions import patterns as P

RING = 12
KINDS = [*P.ACTION_TYPES, "unknown"]
SIGNALS = ["is_err", "obs_key", "err_line", *[f"err_{n}" for n in P.ERROR_CATEGORIES]]
DOUBLES = [f"adv_w{w}_{x}" for w in (5, 10) for x in ("edit_frac", "test_frac", "repeat_ratio", "err_frac", "obs_mean")] + [
    "adv_seq_entropy", "adv_seq_entropy_last10", "adv_seq_entropy_drop", "adv_seq_consec_cmd_sim", "adv_seq_compress",
    "adv_seq_compress_last10", "adv_err_rate", "adv_flow_productive_frac", "adv_flow_env_other_frac",
    "adv_flow_thought_action_ratio", "adv_ix_premature_edit", "adv_ix_repeat_x_err", "adv_ix_blind_edit", "adv_ix_stall_x_churn"]
LONGS = [f"adv_w{w}_{x}" for w in (5, 10) for x in ("n_edit", "n_test", "distinct_cmd")] + [
    f"adv_ts_{x}" for x in ("test", "edit", "search", "error", "new_file", "progress")] + [
    "adv_seq_bigram_repeat", "adv_seq_trigram_repeat", "adv_seq_longest_run", "adv_seq_obs_repeat_max",
    "adv_seq_obs_repeat_recent"] + [f"adv_err_{n}" for n in P.ERROR_CATEGORIES] + [
    "adv_err_streak", "adv_err_recent_total", "adv_err_same_repeated"] + [
    f"adv_flow_{x}" for x in ("has_test", "has_edit", "first_test_step", "edit_then_test", "blind_edits",
                              "new_files_last5", "edits_since_progress", "test_no_improve_streak")]
ERROR_COUNTS = [f"adv_err_{n}" for n in P.ERROR_CATEGORIES]
SCHEMA = ", ".join([*[f"{n} double" for n in DOUBLES], *[f"{n} bigint" for n in LONGS]])


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance with one bit for each character of ``a``."""
    if not a or not b:
        return len(a) or len(b)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for ch in b:
        same = at.get(ch, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, (left << 1) & full
        up, down = (left | ~((same | down) | right)) & full, right & (same | down)
    return score


@lru_cache(10_000)  # runs repeat commands
def similarity(a: str, b: str, measure: str) -> float:
    if measure == "blocks":
        return SequenceMatcher(None, a, b).ratio()
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def entropy(counts: list[int], total: int) -> float:
    return sum(-(n / total) * math.log2(n / total) for n in counts if n)


def _key(*parts: str) -> str:
    return hashlib.md5("\x1f".join(parts).encode()).hexdigest()


def _deflated(raw: bytes) -> float:
    return len(zlib.compress(raw, 6)) / len(raw) if raw else 1.0


def advance(c: dict, table, s: dict, base: dict, before: dict, measure: str, limit: int = 20_000) -> dict:
    """Features of the prefix that ends with step ``s``.

    ``base`` has the base features of this prefix, ``before`` the counters as they were a step earlier
    (kind, fails, read_files). ``table`` holds the keyed counts and the entropies of earlier prefixes.
    """
    k, kind, cmd = c["k"], s["kind"], s["cmd"][:160]
    d = c.setdefault("dyn", {"ring": [], "text": ""})
    ring = d["ring"]
    err = s["is_err"]
    new_read = int(c.get("read_files", 0) > before["read_files"])
    reported, earlier = s["fails"] is not None, before["fails"]
    progress = bool(new_read) or (reported and earlier is not None and s["fails"] < earlier)

    last = ring[-1][3] if ring else None
    pair = similarity(last, cmd, measure) if last is not None and (last or cmd) else None
    if before["kind"] is not None and table.add("bi:" + before["kind"] + ">" + kind) > 1:
        d["bigrams"] = d.get("bigrams", 0) + 1
    if len(ring) > 1 and table.add("tri:" + _key(ring[-2][3], ring[-1][3], cmd)) > 1:
        d["trigrams"] = d.get("trigrams", 0) + 1
    if s["obs_key"] is not None:
        d["obs_max"] = max(d.get("obs_max", 0), table.add("obs:" + s["obs_key"]))
    if s["err_line"] is not None:
        d["err_max"] = max(d.get("err_max", 0), table.add("err:" + s["err_line"]))
    ring = d["ring"] = (ring + [[kind, err, s["obs_len"], cmd, s["obs_key"], new_read, s["thought_len"], s["action_len"], pair,
                                 *[s[f"err_{n}"] for n in P.ERROR_CATEGORIES]]])[-RING:]
    for name, now in (("test", kind == "test"), ("edit", kind == "edit"), ("search", kind == "search"), ("err", err == 1),
                      ("ok", err == 0), ("new", new_read == 1), ("progress", progress)):
        if now:
            d[name] = k
    if kind == "test":
        d.setdefault("first_test", k)
    if progress:
        d["edits"] = c.get("n_edit", 0)
    d["errors"] = d.get("errors", 0) + err
    if reported:
        d["reports"] = d.get("reports", 0) + 1
        if earlier is None or s["fails"] < earlier:
            d["improved"] = d["reports"]
    d["longest"] = max(d.get("longest", 0), c["streak"])
    if len(d["text"].encode()) < limit:
        d["text"] = d["text"] + "\n" + cmd if k > 1 or d["text"] else cmd

    def since(name: str) -> int:
        return k - d.get(name, 0)

    def mean(values: list) -> float:
        known = [v for v in values if v is not None]
        return sum(known) / len(known) if known else 0.0

    n_edit, n_test = c.get("n_edit", 0), c.get("n_test", 0)
    counts = [c.get(f"n_{t}", 0) for t in KINDS]
    out: dict[str, float | int] = {}
    kinds, errors, seen_chars, commands = ([r[i] for r in ring] for i in range(4))
    for w in (5, 10):
        width = min(w, k)
        edits, tests = (kinds[-w:].count(t) for t in ("edit", "test"))
        distinct = len(set(filter(None, commands[-w:])))
        out |= {f"adv_w{w}_n_edit": edits, f"adv_w{w}_n_test": tests, f"adv_w{w}_edit_frac": edits / width,
                f"adv_w{w}_test_frac": tests / width, f"adv_w{w}_distinct_cmd": distinct,
                f"adv_w{w}_repeat_ratio": 1.0 - distinct / width, f"adv_w{w}_err_frac": sum(errors[-w:]) / width,
                f"adv_w{w}_obs_mean": sum(seen_chars[-w:]) / width}
    whole = entropy(counts, k)
    table.keep(f"entropy:{k}", whole)
    half = whole if k == 1 else table.kept(f"entropy:{k // 2}", forget=k % 2 == 1)
    ten = kinds[-10:]
    recent = entropy([ten.count(t) for t in KINDS], min(10, k))
    obs = [r[4] for r in ring[-8:] if r[4] is not None]
    err_rate = d["errors"] / k
    blind = n_edit if n_test == 0 else 0
    out |= {
        "adv_ts_test": since("test"), "adv_ts_edit": since("edit"), "adv_ts_search": since("search"),
        "adv_ts_error": since("err"), "adv_ts_new_file": since("new"), "adv_ts_progress": since("progress"),
        "adv_seq_entropy": whole, "adv_seq_entropy_last10": recent,
        "adv_seq_entropy_drop": None if half is None else half - recent,
        "adv_seq_bigram_repeat": d.get("bigrams", 0), "adv_seq_trigram_repeat": d.get("trigrams", 0),
        "adv_seq_longest_run": d["longest"], "adv_seq_consec_cmd_sim": mean([r[8] for r in ring[-8:]]),
        "adv_seq_obs_repeat_max": d.get("obs_max", 0), "adv_seq_obs_repeat_recent": len(obs) - len(set(obs)),
        "adv_seq_compress": _deflated(d["text"].encode("utf-8", "ignore")[:limit]),
        "adv_seq_compress_last10": _deflated("\n".join(commands[-10:]).encode("utf-8", "ignore")[:limit]),
        **dict(zip(ERROR_COUNTS, map(sum, zip(*[r[9:] for r in ring])))),
        "adv_err_streak": since("ok") if err == 1 else 0, "adv_err_recent_total": sum(errors[-5:]),
        "adv_err_rate": err_rate, "adv_err_same_repeated": d.get("err_max", 0),
        "adv_flow_has_test": int(n_test > 0), "adv_flow_has_edit": int(n_edit > 0),
        "adv_flow_first_test_step": d.get("first_test", -1), "adv_flow_edit_then_test": c.get("edit_test", 0),
        "adv_flow_productive_frac": sum(c.get(f"n_{t}", 0) for t in ("read", "search", "edit", "test")) / k,
        "adv_flow_env_other_frac": (c.get("n_environment", 0) + c.get("n_other", 0)) / k,
        "adv_flow_blind_edits": blind, "adv_flow_new_files_last5": sum(r[5] for r in ring[-5:]),
        "adv_flow_edits_since_progress": n_edit - d.get("edits", 0),
        "adv_flow_test_no_improve_streak": d.get("reports", 0) - d["improved"] if "improved" in d else 0,
        "adv_flow_thought_action_ratio": mean([r[6] for r in ring[-8:]]) / max(1.0, mean([r[7] for r in ring[-8:]])),
        "adv_ix_premature_edit": float(base["edited_before_any_read"] * n_edit),
        "adv_ix_repeat_x_err": base["max_command_repeat_count"] * err_rate, "adv_ix_blind_edit": float(blind),
        "adv_ix_stall_x_churn": float(since("progress") * base["same_file_edit_count_max"]),
    }
    return {n: None if out[n] is None else float(out[n]) for n in DOUBLES} | {n: out[n] for n in LONGS}
