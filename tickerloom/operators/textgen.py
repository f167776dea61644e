"""Labelled training text from templates, filled by a repeatable arithmetic pick."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill_template

OUTPUT = ("id", "text", "label", "label_name", "lang", "source_type", "seed_template_idx")


@dataclass(frozen=True)
class TemplateSet:
    label_name: str
    label: int
    lang: str
    templates: tuple[str, ...]
    slots: dict[str, tuple[str, ...]]

    @property
    def mixes(self) -> int:
        return len(self.templates) * math.prod(len(v) for v in self.slots.values())

    @property
    def texts(self) -> int:
        """Distinct texts: a template makes one for each mix of the slots that it names."""
        return sum(math.prod(len(v) for k, v in self.slots.items() if f"{{{k}}}" in t) for t in self.templates)


COMPANIES = ("Northwind Steel", "Blue Harbor Bank", "Meridian Motors", "Cobalt Software", "Green Delta Power",
             "Lotus Retail", "Summit Cement", "Pinecrest Pharma", "Silverline Telecom", "Orchard Foods", "Granite Realty",
             "Westbay Shipping")
COMPANIES_HI = ("नॉर्थविंड स्टील", "ब्लू हार्बर बैंक", "मेरिडियन मोटर्स", "कोबाल्ट सॉफ्टवेयर", "लोटस रिटेल", "समिट सीमेंट",
                "ग्रीन डेल्टा पावर", "पाइनक्रेस्ट फार्मा", "सिल्वरलाइन टेलीकॉम", "ऑर्चर्ड फूड्स", "ग्रेनाइट रियल्टी", "वेस्टबे शिपिंग")
MOVES = ("1.2%", "1.9%", "2.5%", "3.1%", "3.7%", "4.4%", "5.8%", "6.3%", "7.6%")
QUARTERS = ("Q1", "Q2", "Q3", "Q4")
WHEN = ("on Monday", "on Tuesday", "on Wednesday", "on Thursday", "on Friday", "this week")
WHEN_HI = ("सोमवार को", "मंगलवार को", "बुधवार को", "गुरुवार को", "शुक्रवार को", "इस सप्ताह")
WHEN_MIXED = ("Monday ko", "Tuesday ko", "Wednesday ko", "Thursday ko", "Friday ko", "is hafte")

_EN = {"stock": COMPANIES, "pct": MOVES, "qtr": QUARTERS, "when": WHEN}
_HI = {"stock": COMPANIES_HI, "pct": MOVES, "qtr": QUARTERS, "when": WHEN_HI}
_MIX = {"stock": COMPANIES, "pct": MOVES, "qtr": QUARTERS, "when": WHEN_MIXED}

DEFAULT_SETS = (
    TemplateSet("positive", 1, "en", (
        "{stock} climbs {pct} {when} as {qtr} profit tops forecasts",
        "Order book growth sends {stock} up {pct} {when} after {qtr}",
        "{stock} lifts its outlook {when}, shares gain {pct} on a strong {qtr}"), _EN),
    TemplateSet("neutral", 0, "en", (
        "{stock} little changed {when} before {qtr} numbers, {pct} range seen",
        "{stock} board to meet {when} on {qtr} accounts, stake stays at {pct}"), _EN),
    TemplateSet("negative", -1, "en", (
        "{stock} slides {pct} {when} on weak {qtr} margins",
        "Regulator penalty drags {stock} lower by {pct} {when} in {qtr}",
        "{stock} cuts {qtr} guidance {when}, shares fall {pct}"), _EN),
    TemplateSet("positive", 1, "hi", (
        "{stock} के शेयर {when} {pct} चढ़े, {qtr} में मुनाफा बढ़ा", "{when} {stock} में {pct} की तेजी, {qtr} नतीजे मजबूत"), _HI),
    TemplateSet("neutral", 0, "hi", (
        "{when} {stock} {qtr} नतीजों से पहले स्थिर, दायरा {pct}", "{stock} की बैठक {when}, {qtr} खातों पर चर्चा, हिस्सा {pct}"), _HI),
    TemplateSet("negative", -1, "hi", (
        "{when} {stock} {pct} गिरा, {qtr} नतीजे कमजोर", "{stock} को {qtr} में नुकसान, शेयर {when} {pct} टूटे"), _HI),
    TemplateSet("positive", 1, "hinglish", (
        "{stock} mein {when} {pct} ki tezi, {qtr} results mazboot", "{when} {stock} ka munafa badha, {qtr} ke baad share {pct} upar"), _MIX),
    TemplateSet("neutral", 0, "hinglish", (
        "{when} {stock} {qtr} results se pehle flat raha, range {pct}", "{stock} ki board meeting {when}, {qtr} accounts par baat, stake {pct}"), _MIX),
    TemplateSet("negative", -1, "hinglish", (
        "{stock} mein {when} {pct} ki girawat, {qtr} guidance kamzor", "{when} {stock} ko {qtr} mein nuksan, share {pct} neeche"), _MIX),
)


def pick(values: Sequence[str], key: Column, stride: int) -> Column:
    """One of the values, chosen by pmod(floor(key / stride), n)."""
    index = F.pmod(F.floor(key / F.lit(stride)), F.lit(len(values))).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def fill_set(seeds: DataFrame, key: str, spec: TemplateSet) -> DataFrame:
    """One text per seed row; slot strides are products of the list sizes, so keys walk all mixes."""
    k = F.col(key)
    n = len(spec.templates)
    template_index = F.pmod(k, F.lit(n)).cast("int")
    template = F.element_at(F.array(*[F.lit(t) for t in spec.templates]), template_index + 1)
    stride, slots = n, {}
    for name, values in spec.slots.items():
        slots[name] = pick(values, k, stride)
        stride *= len(values)
    text = fill_template(template, slots)
    return seeds.select(
        F.substring(F.md5(text), 1, 12).alias("id"), text.alias("text"), F.lit(spec.label).alias("label"),
        F.lit(spec.label_name).alias("label_name"), F.lit(spec.lang).alias("lang"),
        F.lit("generated").alias("source_type"), template_index.alias("seed_template_idx"), k.alias("_key"),
    )


def generate(seeds: DataFrame, key: str, sets: Sequence[TemplateSet] = DEFAULT_SETS,
             target_per_label: int | None = None) -> DataFrame:
    """Unique texts over all sets; optionally the first ``target_per_label`` per set, which must be within reach."""
    parts = []
    for spec in sets:
        # everything but the template index follows from the text: a hash aggregate, not a sort
        if target_per_label is not None and spec.texts < target_per_label:
            raise ValueError(f"{spec.lang} {spec.label_name}: templates make {spec.texts} texts, {target_per_label} are asked for")
        filled = fill_set(seeds, key, spec)
        fixed = [c for c in OUTPUT if c not in ("text", "seed_template_idx")]
        unique = filled.groupBy("text", *fixed).agg(
            F.min_by("seed_template_idx", "_key").alias("seed_template_idx"), F.min("_key").alias("_key")
        )
        if target_per_label is not None:
            unique = unique.orderBy("_key").limit(target_per_label)
        parts.append(unique)
    return reduce(lambda a, b: a.unionByName(b), parts).select(*OUTPUT)


def label_counts(texts: DataFrame) -> DataFrame:
    return texts.groupBy("label_name").agg(F.count(F.lit(1)).alias("n"))
