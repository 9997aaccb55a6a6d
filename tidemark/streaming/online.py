"""Online scoring: a client's point-in-time features as messages arrive, by the rules of the batch windows.

A message waits until the watermark has passed its time, so that those that came out of order, by up to the watermark's delay,
are taken in order of time and message_id. It is scored from the state that earlier messages left, and only then
absorbed. Later ones than that are dropped by the watermark; messages without a time aren't scored. The state is a
row and the campaigns of a client, whatever the number of messages; only what waits is kept as it came.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import clean
from tidemark.operators import history, similarity

FLAGS = ("is_opened", "is_clicked", "is_unsubscribed", "is_complained")
HOURS = tuple(history.RECENCIES.values())
CHANNELS = len(clean.STATE_CHANNELS)
#: What an arriving message is kept as while it waits, beside its time and id.
MESSAGE = "campaign_id long, code int, vec long, is_purchased int, purchased_h double, first_purchase_h double, " + ", ".join(f"{c} int" for c in FLAGS) + ", " + ", ".join(f"{c} double" for c in HOURS)
#: What earlier messages leave.
PAST = "n long, purchases long, campaigns long, first_purchase_h double, bought_h double, won long, " + ", ".join(f"{c} int" for c in FLAGS) + ", " + ", ".join(f"{c} double" for c in HOURS) + ", " + ", ".join(f"last_{i} double" for i in range(CHANNELS))
SCORED = "message_id long, client_id long, total_messages long, total_purchases long, total_campaigns long, " + ", ".join(f"prev_{c} int" for c in FLAGS) + ", " + ", ".join(f"{c} double" for c in (*history.RECENCIES, "avg_time_since_first_purchase", "purchase_days")) + ", feat_fatigue double, feat_cooldown_ok int, feat_like_last_success double"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _plain(value: Any) -> Any:
    """A cell of a pandas row as a Python value; missing is None."""
    return None if value is None or value != value else value.item() if hasattr(value, "item") else value


def scored(past: dict[str, Any], m: dict[str, Any]) -> dict[str, Any]:
    """A message's features from what its client's earlier ones left."""
    t, last = m["t"], [past[f"last_{i}"] for i in range(CHANNELS)]
    since = lambda h: None if h is None else t - h
    own, tau = last[m["code"]], [history.TAU[c] for c in clean.STATE_CHANNELS]
    either = m["vec"] | past["won"] if past["won"] is not None else 0
    first = m["first_purchase_h"] if m["first_purchase_h"] is not None else past["first_purchase_h"]
    return {
        "message_id": m["message_id"],
        "total_messages": past["n"],
        "total_purchases": past["purchases"],
        "total_campaigns": past["campaigns"],
        **{f"prev_{c}": past[c] or 0 for c in FLAGS},
        **{new: since(past[src]) for new, src in history.RECENCIES.items()},
        "avg_time_since_first_purchase": since(first),
        "purchase_days": None if past["bought_h"] is None else (t - past["bought_h"]) / 24,
        "feat_fatigue": sum(math.exp(-(t - h) / tau[i]) for i, h in enumerate(last) if h is not None and t - h >= 0),
        "feat_cooldown_ok": int(own is None or t - own >= history.COOL[clean.STATE_CHANNELS[m["code"]]]),
        "feat_like_last_success": (m["vec"] & past["won"]).bit_count() / either.bit_count() if either else 0.0,
    }


def absorbed(past: dict[str, Any], m: dict[str, Any], new_campaign: bool) -> dict[str, Any]:
    """What is left after a message."""
    kept = {c: m[c] if m[c] is not None else past[c] for c in (*FLAGS, *HOURS, "first_purchase_h")}
    bought = m["is_purchased"] == 1
    paid = {"bought_h": m["purchased_h"] if m["purchased_h"] is not None else m["t"], "won": m["vec"]} if bought else {}
    return past | kept | paid | {"n": past["n"] + 1, "purchases": past["purchases"] + int(bought), "campaigns": past["campaigns"] + int(new_campaign), f"last_{m['code']}": m["t"]}


class ClientFeatures(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", PAST)
        self.campaigns = handle.getMapState("campaigns", "campaign_id long", "seen boolean")
        self.waiting = handle.getMapState("waiting", "t double, message_id long", MESSAGE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        for part in rows:
            for row in part[["t", "message_id", "ms", *_names(MESSAGE)]].itertuples(index=False):
                t, message_id, ms, *message = map(_plain, row)
                self.waiting.updateValue((float(t), int(message_id)), tuple(float(v) if k == "double" and v is not None else int(v) if v is not None else None for v, k in zip(message, (x.split()[1] for x in MESSAGE.split(", ")), strict=True)))
                self.handle.registerTimer(int(ms))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        until = expiredTimerInfo.getExpiryTimeInMs() / 3_600_000
        ready = sorted((k, v) for k, v in self.waiting.iterator() if k[0] <= until + 1e-9)
        names = _names(PAST)
        known = self.past.get()
        past = dict(zip(names, known, strict=True)) if known is not None else dict.fromkeys(names) | {"n": 0, "purchases": 0, "campaigns": 0}
        out = []
        for (t, message_id), values in ready:
            m = {"t": t, "message_id": message_id} | dict(zip(_names(MESSAGE), values, strict=True))
            out.append({"client_id": key[0]} | scored(past, m))
            new = not self.campaigns.containsKey((m["campaign_id"],))
            if new:
                self.campaigns.updateValue((m["campaign_id"],), (True,))
            past = absorbed(past, m, new)
            self.waiting.removeKey((t, message_id))
        if ready:
            self.past.update(tuple(past[c] for c in names))
            yield pd.DataFrame(out, columns=_names(SCORED)).astype({c: "Int64" for c in _names(SCORED) if f"{c} int" in SCORED or f"{c} long" in SCORED})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def arriving(log: DataFrame) -> DataFrame:
    """The columns of an enriched log that online scoring takes; sent_at as a timestamp, for the watermark."""
    channel = clean.channel_code(F.lower(F.trim(F.coalesce("channel", F.lit("unknown")))))
    own = [c for c in _names(MESSAGE) if c not in ("code", "vec")]
    rows = log.select("client_id", "message_id", "t", F.col("sent_at").cast("timestamp").alias("sent_at"), channel.alias("code"), similarity.bits(similarity.ATTRIBUTES).alias("vec"), *own)
    return rows.where("t IS NOT NULL").withColumn("ms", F.round(F.col("t") * 3_600_000).cast("long"))


def features(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """SCORED of a stream of arriving() rows; delay: how much later than its turn a message may come.

    The session must keep state in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    return stream.withWatermark("sent_at", delay).groupBy("client_id").transformWithStateInPandas(statefulProcessor=ClientFeatures(), outputStructType=SCORED, outputMode="Append", timeMode="EventTime")
