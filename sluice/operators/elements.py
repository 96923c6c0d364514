"""Page elements: inference, private values, compaction, masks and risk predicates.

An element row has snapshot_id, id, role, tag, text, label, input_type, enabled, visible, selected, value_present,
options, selected_option, control_value, dom_index, bbox {x, y, width, height} and sources. Functions take the names
they need as columns of the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.patterns import EDGE

c = F.col


def handle_kind(input_type: Column, label: Column) -> Column:
    """Kind of value a field takes; the first that applies, null if none."""
    name = F.coalesce(F.lower(label), F.lit(""))
    has = name.contains
    kind = F.coalesce(input_type, F.lit(""))
    return (
        F.when((kind == "email") | has("email"), "EMAIL").when((kind == "tel") | has("phone") | has("mobile"), "PHONE").when((kind == "password") | has("password"), "PASSWORD")
        .when(has("upi"), "UPI_ID").when(has("first name"), "GIVEN_NAME").when(has("last name"), "SURNAME").when(has("address"), "ADDRESS")
        .when(has("username") | has("user name"), "USERNAME").when(has("name"), "PERSON_NAME").when((kind == "search") | has("search"), "TEXT").when((kind == "text") & has("text input"), "TEXT")
    )


def element_kinds(input_type: Column, label: Column, text: Column) -> Column:
    """Every kind that a field can take, as an array."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", label, text)), "-", " "), r"\s+", " "))
    has = name.contains
    kind = F.coalesce(input_type, F.lit(""))
    first = F.array_compact(F.array(
        F.when((kind == "email") | has("email"), "EMAIL"), F.when((kind == "tel") | name.rlike(rf"{EDGE}(?:phone|mobile){EDGE}"), "PHONE"), F.when((kind == "password") | has("password"), "PASSWORD"),
        F.when(has("first name"), "GIVEN_NAME"), F.when(has("first name"), "PERSON_NAME"), F.when(has("last name"), "SURNAME"), F.when(has("last name"), "PERSON_NAME"),
    ))
    rest = F.array_compact(F.array(
        F.when(has("full name") | (has("name") & (F.size(first) == 0)), "PERSON_NAME"), F.when(has("address"), "ADDRESS"), F.when(has("upi"), "UPI_ID"), F.when(has("otp"), "OTP"),
        F.when(has("username") | has("user name"), "USERNAME"), F.when((kind == "search") | has("search") | has("text input"), "TEXT"),
    ))
    return F.array_distinct(F.concat(first, rest))


def inferred_role(role: Column, tag: Column, type_: Column) -> Column:
    """A given role, else what tag and type imply."""
    return F.coalesce(
        F.nullif(F.trim(role), F.lit("")),
        F.when(tag == "a", "link").when(tag == "button", "button").when(tag == "select", "combobox").when(tag == "textarea", "textbox").when(tag.isin("img", "canvas"), "img")
        .when(tag == "input", F.when(type_.isin("button", "submit", "reset", "image"), "button").when(type_.isin("checkbox", "radio"), type_).when(type_ == "range", "slider").otherwise("textbox"))
        .when(tag.rlike("^h[1-6]$"), "heading").otherwise(tag),
    )


def private_values(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The elements without their values, and the side table of values (snapshot_id, element_id, input_type, value)."""
    side = elements.filter(F.length(F.trim("value")) > 0).select("snapshot_id", c("id").alias("element_id"), F.coalesce("input_type", F.lit("text")).alias("input_type"), "value")
    return elements.drop("value"), side


def is_masked_input() -> Column:
    """Visible inputs whose pixels are private: passwords, and filled fields that take free text."""
    plain = ("checkbox", "radio", "button", "submit", "reset", "range", "color", "hidden")
    filled = c("value_present") & ((c("role") == "textbox") | (c("tag") == "textarea") | ((c("tag") == "input") & ~F.coalesce("input_type", F.lit("text")).isin(*plain)))
    return F.coalesce(c("visible") & ((F.coalesce("input_type", F.lit("")) == "password") | filled), F.lit(False))


def compact(elements: DataFrame) -> DataFrame:
    """compact: the element as JSON with prose bounded, nulls and empty arrays left out, false and zero kept."""
    bbox = F.when(c("bbox").isNotNull(), F.struct(*[F.round(c(f"bbox.{k}"), 1).alias(k) for k in ("x", "y", "width", "height")]))
    options = F.transform(F.slice(F.coalesce("options", F.array()), 1, 24), lambda o: F.substring(o, 1, 240))
    some = lambda a: F.when(F.size(a) > 0, a)
    body = F.struct(
        "id", "role", F.nullif(F.substring("text", 1, 320), F.lit("")).alias("text"), F.nullif(F.substring("label", 1, 200), F.lit("")).alias("label"), "input_type", "value_handle", "enabled", "selected", "value_present",
        some(options).alias("options"), "selected_option", "control_value", "dom_index", bbox.alias("bbox"), some(c("sources")).alias("sources"),
    )
    return elements.withColumn("compact", F.to_json(body))


def is_high_risk(type_: Column, name: Column, verbs: tuple[str, ...]) -> Column:
    """Filling a handle always, a click if its target names one of the verbs."""
    return F.coalesce((type_ == "TYPE_HANDLE") | ((type_ == "CLICK") & name.rlike(rf"(?i){EDGE}(?:{'|'.join(verbs)}){EDGE}")), F.lit(False))


#: Verbs of consequence.
RISKY_VERBS = ("submit", "pay", "purchase", "buy", "send", "delete", "remove", "confirm", "transfer", "publish", "order", "book", "checkout", "apply")


def is_actionable() -> Column:
    return F.coalesce(c("enabled") & ((F.size(F.coalesce("options", F.array())) > 0) | c("role").isin("button", "textbox", "checkbox", "radio")), F.lit(False))


def is_safe_control(field: Column, role: Column, value: Column, label: Column, placeholders: Column) -> Column:
    """A contextual hit on a plain control that is no private value: all placeholders are name or address parts, the
    value is generic, and the label has no private cue."""
    cue = rf"(?i){EDGE}(?:name|person|recipient|patient|customer|address|street|beneficiary|account holder|employee|doctor|contact){EDGE}"
    generic = r"(?i)^(?:(?:option|checkbox|radio(?:\s+button)?|button|item|choice|field|row)\s*(?:#|no\.?|number)?\s*\d+|[a-z0-9][a-z0-9+#._/-]{0,31})$"
    parts = F.transform(placeholders, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\[", ""), r"_\d+\]$", ""))
    named = F.forall(parts, lambda p: p.isin("GIVEN_NAME", "SURNAME", "BUILDING_NUMBER", "STREET_NAME", "SECONDARY_ADDRESS"))
    return (
        field.isin("OPTION", "CONTROL_VALUE", "LABEL") & F.coalesce(role, F.lit("")).isin("combobox", "checkbox", "radio", "button", "option")
        & ~F.coalesce(label, F.lit("")).rlike(cue) & F.trim(value).rlike(generic) & (F.size(placeholders) > 0) & named
    )


def contextual_type(placeholder: Column) -> Column:
    """Entity type of a model placeholder such as [GIVEN_NAME_1]."""
    kind = F.regexp_replace(F.regexp_replace(placeholder, r"^\[", ""), r"_\d+\]$", "")
    return (
        F.when(kind.isin("GIVEN_NAME", "SURNAME"), "PERSON_NAME").when(kind.isin("PHONE", "EMAIL"), kind).when(kind == "CREDIT_CARD", "PAYMENT_CARD")
        .when(kind.isin("BANK_ACCOUNT", "ROUTING_NUMBER"), "ACCOUNT_ID").when(kind.isin("BUILDING_NUMBER", "STREET_NAME", "SECONDARY_ADDRESS"), "ADDRESS").otherwise("OTHER")
    )


def metadata_entities(elements: DataFrame, values: DataFrame, found: DataFrame) -> DataFrame:
    """Entities that an input's metadata implies: a private value of a password, name or address field without a text
    hit, and a password field without a password hit. Columns: snapshot_id, element_id, type, confidence, raw_value."""
    labels = elements.select("snapshot_id", c("id").alias("element_id"), c("input_type").alias("own_type"), "label")
    kind = handle_kind(c("input_type"), c("label"))
    implied = F.when(c("input_type") == "password", "PASSWORD").when(kind.isin("GIVEN_NAME", "SURNAME", "PERSON_NAME"), "PERSON_NAME").when(kind == "ADDRESS", "ADDRESS")
    hits = found.filter("field = 'PRIVATE_VALUE'").select("snapshot_id", "element_id").distinct()
    first = (
        values.join(labels, ["snapshot_id", "element_id"], "left").join(hits, ["snapshot_id", "element_id"], "left_anti").withColumn("type", implied).filter("type is not null")
        .select("snapshot_id", "element_id", "type", F.lit(1.0).alias("confidence"), c("value").alias("raw_value"))
    )
    known = found.filter("type = 'PASSWORD'").select("snapshot_id", "element_id").union(first.filter("type = 'PASSWORD'").select("snapshot_id", "element_id")).distinct()
    second = labels.filter("own_type = 'password'").join(known, ["snapshot_id", "element_id"], "left_anti")
    return first.unionByName(second.select("snapshot_id", "element_id", F.lit("PASSWORD").alias("type"), F.lit(1.0).alias("confidence"), F.lit("").alias("raw_value")))


def visual_entities(hints: DataFrame, ocr: DataFrame, regions: DataFrame) -> DataFrame:
    """Entities of visual hints (confidence 1) and OCR hints, and a private document of confidence 0.5 for each region
    that needs analysis and has no visual hint."""
    none = F.lit(None).cast("string")
    seen = hints.select("snapshot_id", "region_id", "type", F.lit("VISION").alias("source"), F.lit(1.0).alias("confidence"), F.lit("").alias("raw_value"), "evidence_id")
    read = ocr.select("snapshot_id", "region_id", "type", F.lit("OCR").alias("source"), "confidence", F.coalesce("raw_value", F.lit("")).alias("raw_value"), none.alias("evidence_id"))
    bare = regions.filter("requires_analysis").join(hints.select("snapshot_id", "region_id"), ["snapshot_id", "region_id"], "left_anti")
    rest = bare.select("snapshot_id", "region_id", F.lit("PRIVATE_DOCUMENT").alias("type"), F.lit("VISION").alias("source"), F.lit(0.5).alias("confidence"), F.lit("").alias("raw_value"), none.alias("evidence_id"))
    return seen.unionByName(read).unionByName(rest)


def attach_handles(elements: DataFrame, tasks: DataFrame, first_handles: DataFrame | None = None) -> DataFrame:
    """value_handle: the task's handle (or the vault's first) for an empty field, if it is the only empty one of its
    kind in the snapshot and the task asks for it. tasks: snapshot_id, task (localised), asks for kinds by words."""
    kind = handle_kind(c("input_type"), c("label"))
    words = {
        "EMAIL": "email", "PHONE": "(?:phone|mobile)", "PERSON_NAME": r"(?:full\s+)?name", "GIVEN_NAME": r"first\s+name", "SURNAME": r"last\s+name", "ADDRESS": "address",
        "PASSWORD": "password", "OTP": "otp", "UPI_ID": "upi", "USERNAME": r"user\s*name", "TEXT": r"(?:text\s+input|search)",
    }
    asked = F.lit(False)
    for k, w in words.items():
        asked = asked | ((c("kind_") == k) & c("task").rlike(rf"(?i){EDGE}{w}{EDGE}"))
    verb = c("task").rlike(rf"(?i){EDGE}(?:fill|enter|type|use|add|provide){EDGE}")
    rows = elements.withColumn("kind_", kind).withColumn("empty_", F.sum((~c("value_present")).cast("int")).over(Window.partitionBy("snapshot_id", "kind_")))
    rows = rows.join(tasks.select("snapshot_id", "task"), "snapshot_id", "left").withColumn("own_", F.expr(
        r"try_element_at(filter(regexp_extract_all(coalesce(task, ''), '(?<![A-Za-z0-9_])LOCAL_[A-Z_]+_[1-9][0-9]*(?![A-Za-z0-9_])', 0), h -> regexp_replace(h, '^LOCAL_|_[0-9]+$', '') = kind_), 1)"
    ))
    if first_handles is not None:
        rows = rows.join(first_handles.select(c("snapshot_id"), c("kind").alias("kind_"), c("handle").alias("vault_")), ["snapshot_id", "kind_"], "left")
    else:
        rows = rows.withColumn("vault_", F.lit(None).cast("string"))
    fits = ~c("value_present") & c("kind_").isNotNull() & (c("own_").isNotNull() | (verb & asked)) & (c("empty_") == 1)
    return rows.withColumn("value_handle", F.when(fits, F.coalesce("own_", "vault_"))).drop("kind_", "empty_", "own_", "vault_", "task")


def remapped_option(options: Column, redacted: Column, selected: Column) -> Column:
    """The redacted text of the selected option, found by its place among the options."""
    at = F.array_position(options, selected)
    return F.when(at > 0, F.try_element_at(redacted, at.cast("int")))


def lowest_price(options: Column, price) -> Column:
    """The first option of the least price; options without one count as infinite."""
    priced = F.transform(options, lambda o, i: F.struct(F.coalesce(price(o), F.lit(float("inf"))).alias("p"), i.alias("i"), o.alias("option")))
    return F.array_min(priced)["option"]


def screen_summary(elements: DataFrame, by: str = "snapshot_id") -> DataFrame:
    """interactive and visual counts, the first six names of controls and six distinct readings, in order of dom_index."""
    name = F.trim(F.concat_ws(" ", F.nullif("label", F.lit("")), F.nullif("text", F.lit("")), F.nullif("control_value", F.lit(""))))
    interactive = c("role").isin("button", "link", "textbox", "combobox", "checkbox", "radio", "switch", "tab")
    visual = F.exists(F.coalesce("sources", F.array().cast("array<string>")), lambda s: s.isin("VISION", "OCR"))
    firsts = Window.partitionBy(by).orderBy("dom_index", "id")
    rows = elements.withColumn("name_", F.when(interactive & (name != ""), name)).withColumn("read_", F.when(visual, F.nullif(F.trim("text"), F.lit(""))))
    rows = rows.withColumn("nth_", F.count("name_").over(firsts))
    reads = rows.filter("read_ is not null").groupBy(by, "read_").agg(F.min(F.struct("dom_index", "id")).alias("at_"))
    reads = reads.withColumn("n_", F.row_number().over(Window.partitionBy(by).orderBy("at_"))).filter("n_ <= 6")
    reads = reads.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_", "read_"))), lambda x: F.substring(x["read_"], 1, 160)).alias("readings"))
    sums = rows.groupBy(by).agg(
        F.count_if(interactive).alias("interactive"), F.count_if(visual).alias("visual"),
        F.transform(F.array_sort(F.collect_list(F.when(c("name_").isNotNull() & (c("nth_") <= 6), F.struct("nth_", "name_")))), lambda x: x["name_"]).alias("names"),
    )
    return sums.join(reads, by, "left").withColumn("readings", F.coalesce("readings", F.array().cast("array<string>")))
