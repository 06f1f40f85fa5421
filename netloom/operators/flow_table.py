"""Packets to flows: filters, the server's side, sessions, features. A table and a stream give the same.

A flow is the packets of one pair of endpoints. Its first packet settles which end is the server:
the target of a SYN, the sender of a SYN with ACK, else the lower port (a guess). A packet from the
server has direction 1, one to it 0. A flow ends when ``dim`` packets of ``select`` have come, or
when nothing comes for ``idle`` seconds or more; the next packet begins a new one. Flows that have
not ended with the table end there (``aged``); in a stream they wait for the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import rules

SYN, ACK = 0x02, 0x10
FLOW = "flow string, first double, last double, server_ip string, guessed boolean, lens array<bigint>, acks array<bigint>, dirs array<int>, aged boolean"


def networks(entries: list[str]) -> list[tuple[int, int] | str]:
    """CIDR entries of IPv4 as (network, mask), others as they are; what is neither is left out."""
    import ipaddress

    out: list = []
    for e in entries:
        try:
            if "/" in e:
                net = ipaddress.IPv4Network(e, strict=False)
                out.append((int(net.network_address), int(net.netmask)))
            else:
                out.append(str(ipaddress.ip_address(e)))
        except ValueError:
            continue
    return out


def in_networks(ip: Column, nets: list) -> Column:
    part = F.split(ip, "[.]")
    number = sum((F.element_at(part, i + 1).cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    v4 = ip.rlike(r"^[0-9]+([.][0-9]+){3}$")
    out = F.lit(False)
    for n in nets:
        out |= (ip == n) if isinstance(n, str) else F.coalesce(F.when(v4, number).bitwiseAND(F.lit(n[1])) == n[0], F.lit(False))
    return out


def kept(packets: DataFrame, skip_ports=rules.SKIP_PORTS, skip_nets: list | None = None) -> DataFrame:
    """packets: ``src, dst, sport, dport, ack, flags, payload_len, ts`` (seconds). TCP packets whose lower port and
    addresses are not to be skipped; adds ``flow``, the endpoints in canonical order."""
    out = packets.where(~F.least("sport", "dport").isin(*skip_ports)) if skip_ports else packets
    if skip_nets:
        out = out.where(~in_networks(F.col("src"), skip_nets) & ~in_networks(F.col("dst"), skip_nets))
    end = lambda ip, port: F.struct(rules.address_key(F.col(ip)).alias("k"), F.col(port).alias("p"), F.concat(F.col(ip), F.lit(" "), F.col(port).cast("string")).alias("t"))
    ends = F.array_sort(F.array(end("src", "sport"), end("dst", "dport")))
    return out.withColumn("flow", F.concat(ends[0]["t"], F.lit(" "), ends[1]["t"]))


class _Open:
    """A flow on its way: small, as it ends with ``dim`` packets of one direction."""

    def __init__(self, row=None):
        if row is not None:
            self.first, self.last, self.server, self.guessed, self.lens, self.acks, self.dirs = row

    def begin(self, p) -> None:
        src, dst = (p.src, p.sport), (p.dst, p.dport)
        syn, ack = p.flags & SYN, p.flags & ACK
        if syn:
            server, self.guessed = (src if ack else dst), False
        else:
            # of equal ports the first endpoint in canonical order
            a = (p.flow.split(" ")[0], int(p.flow.split(" ")[1]))
            server, self.guessed = (a if p.sport == p.dport else min(src, dst, key=lambda e: e[1])), True
        self.first, self.server, self.lens, self.acks, self.dirs = p.ts, f"{server[0]} {server[1]}", [], [], []

    def add(self, p) -> None:
        self.last = p.ts
        self.lens.append(int(p.payload_len))
        self.acks.append(int(p.ack))
        self.dirs.append(int(f"{p.src} {p.sport}" == self.server))

    def row(self, flow: str, aged: bool) -> tuple:
        return flow, self.first, self.last, self.server.rsplit(" ", 1)[0], self.guessed, self.lens, self.acks, self.dirs, aged

    def state(self) -> tuple:
        return self.first, self.last, self.server, self.guessed, self.lens, self.acks, self.dirs


def _step(open_: _Open | None, p, dim: int, select: int, idle: float) -> tuple[_Open | None, list[tuple]]:
    out = []
    if open_ is not None and p.ts - open_.last >= idle:
        out.append(open_.row(p.flow, True))
        open_ = None
    if open_ is None:
        open_ = _Open()
        open_.begin(p)
    open_.add(p)
    if sum(d == select for d in open_.dirs) >= dim:
        out.append(open_.row(p.flow, False))
        open_ = None
    return open_, out


_COLUMNS = [c.split()[0] for c in FLOW.split(", ")]


def flows(packets: DataFrame, dim: int = 10, select: int = 1, idle: float = 30.0, apart: list[str] | None = None) -> DataFrame:
    """packets: of ``kept``, with a ``seq`` that orders equal times. FLOW rows. Packets stream through
    in order of (flow, time): a task holds one open flow, however many packets its endpoints have.

    apart: columns that tell packets of the same endpoints apart (where or by whom they were captured):
    each of their values has flows of its own."""
    apart = list(apart or [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, open_ = None, None
        for f in frames:
            out = []
            for p in f.itertuples(index=False):
                if (now := (p.flow, *p[: len(apart)])) != name:
                    if open_ is not None:
                        out.append(open_.row(name[0], True))
                    name, open_ = now, None
                open_, more = _step(open_, p, dim, select, idle)
                out += more
            yield pd.DataFrame(out, columns=_COLUMNS)
        if open_ is not None:
            yield pd.DataFrame([open_.row(name[0], True)], columns=_COLUMNS)

    # as text, so that nulls are equal to each other; first, so that their names can't clash
    more = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"_apart{i}") for i, c in enumerate(apart)]
    of = [f"_apart{i}" for i in range(len(apart))]
    p = packets.select(*more, "flow", "src", "dst", "sport", "dport", "ack", "flags", "payload_len", F.col("ts").cast("double").alias("ts"), "seq")
    return p.repartition("flow", *of).sortWithinPartitions("flow", *of, "ts", "seq").mapInPandas(run, FLOW)


def flow_stream(packets: DataFrame, dim: int = 10, select: int = 1, idle: float = 30.0, late: str = "10 seconds") -> DataFrame:
    """The same of a stream; packets: as above with ``at timestamp``. An idle flow ends when the watermark passes it."""
    state = "first double, last double, server string, guessed boolean, lens array<bigint>, acks array<bigint>, dirs array<int>"

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        out, open_ = [], _Open([list(x) if hasattr(x, "__len__") and not isinstance(x, str) else x for x in held.get]) if held.exists else None
        if held.hasTimedOut:
            yield pd.DataFrame([open_.row(key[0], True)], columns=_COLUMNS)
            held.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable")
        for p in rows.itertuples(index=False):
            open_, more = _step(open_, p, dim, select, idle)
            out += more
        if open_ is None:
            if held.exists:
                held.remove()
        else:
            held.update(open_.state())
            held.setTimeoutTimestamp(max(int((open_.last + idle) * 1000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=_COLUMNS)

    p = packets.withWatermark("at", late).select("flow", "src", "dst", "sport", "dport", "ack", "flags", "payload_len", F.col("ts").cast("double").alias("ts"), "seq", "at")
    return p.groupBy("flow").applyInPandasWithState(run, FLOW, state, "append", GroupStateTimeout.EventTimeTimeout)


def features(flows: DataFrame, dim: int = 10, select: int = 1) -> DataFrame:
    """Adds ``features array<float>``: lengths of the first ``dim`` packets of ``select``, then their
    changes of acknowledgement number, negated: the first is 0, what does not grow leaves no place,
    what grows by over 100,000 counts as 0; zeros fill up."""
    chosen = F.slice(F.filter(F.arrays_zip("dirs", "lens", "acks"), lambda x: x["dirs"] == select), 1, dim)
    pad = lambda x: F.slice(F.concat(x, F.array_repeat(F.lit(0).cast("long"), dim)), 1, dim)
    acks = F.transform("_chosen", lambda x: x["acks"])
    steps = F.transform(F.slice(acks, 2, dim), lambda a, i: a - acks[i])
    steps = F.transform(F.filter(steps, lambda d: d > 0), lambda d: F.when(d > 100_000, F.lit(0).cast("long")).otherwise(-d))
    first = F.array(F.lit(0).cast("long"))
    both = F.concat(pad(F.transform("_chosen", lambda x: x["lens"])), pad(F.concat(first, steps)))
    return flows.withColumn("_chosen", chosen).withColumn("features", both.cast("array<float>")).drop("_chosen")
