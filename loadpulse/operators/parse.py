"""From message text to typed transaction records, and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .. import schemas
from ..functions import timing

_RECORDS = T.ArrayType(schemas.TRANSACTION)
# The same records with every field as text: a field that is absent (null text)
# can then be told from one whose text does not fit its type.
_TEXT_RECORD = T.StructType(
    [T.StructField(f.name, T.StringType()) for f in schemas.TRANSACTION.fields]
)
_NUMBERS = [f.name for f in schemas.TRANSACTION.fields if isinstance(f.dataType, T.DoubleType)]
_KEYS = ["job_id", "operation"]
_MAY_BE_ABSENT = ["workload_id"]


def _array_of(schema: T.ArrayType, closing: str, closes: Callable[[Column], Column]) -> Column:
    """The array of a message, or null if its text is not one JSON array.

    The JSON reader stops at the end of the first value, so text after an array would
    go unseen.  The message is therefore read as the first of two elements, and the
    second one holds the text's own SHA-256 (in ``closing``, where ``%s`` stands).  A
    text can bring elements of its own, but not that one: if the second of two elements
    has it (``closes``), the first one is the whole text.
    """
    before, after = closing.split("%s")
    wrapped = F.concat(F.lit("["), F.col("data"), F.lit("," + before), _digest(), F.lit(after + "]"))
    both = F.from_json(wrapped, T.ArrayType(schema))
    # A variable of a lambda: the text is read once, however often the result is used.
    return F.transform(F.array(both), lambda b: F.when(
        (F.size(b) == 2) & (closes(b[1]) == _digest()), b[0]))[0]


def _digest() -> Column:
    return F.sha2("data", 256)


def _doubtful(items: Column) -> Column:
    """Whether a message has a record that reading by type alone cannot settle."""
    needed = [n for n in schemas.TRANSACTION.fieldNames() if n not in _MAY_BE_ABSENT]

    def incomplete(record: Column) -> Column:
        missing = record.isNull()
        for name in needed:
            missing = missing | record[name].isNull()
        return missing

    return F.coalesce(F.exists(items, incomplete), F.lit(True))


def _usable(record: Column) -> Column:
    """Whether a text record has its keys and no field of a wrong type."""
    usable = record.isNotNull()
    for name in _KEYS:
        usable = usable & record[name].isNotNull()
    for name in _NUMBERS:
        usable = usable & (record[name].isNull() | record[name].try_cast("double").isNotNull())
    success = record["success"]
    return F.coalesce(
        usable & (success.isNull() | F.lower(success).isin("true", "false")), F.lit(False))


def _typed(record: Column) -> Column:
    """A usable text record by type: an absent number is 0, an absent success false."""
    columns = []
    for name in schemas.TRANSACTION.fieldNames():
        column = record[name]
        if name in _NUMBERS:
            column = F.coalesce(column.try_cast("double"), F.lit(0.0))
        elif name == "success":
            column = F.coalesce(F.lower(column) == "true", F.lit(False))
        columns.append(column.alias(name))
    return F.struct(*columns)


def _element(text: Column) -> Column:
    """One element of an array: its text, and its fields as text if it is an object."""
    record = F.when(text.startswith("{"), F.from_json(text, _TEXT_RECORD))
    return F.struct(text.alias("text"), record.alias("record"))


def _with_items(messages: DataFrame) -> DataFrame:
    """Messages with their typed ``items`` and, for doubtful ones, their ``elements``.

    Reading by type is the fast path; the second reading, element by element, happens
    only for the messages that need it.
    """
    typed = _array_of(_RECORDS, '[{"job_id":"%s"}]', lambda last: F.get(last, F.lit(0))["job_id"])
    read = messages.select("publish_time", "data", typed.alias("items"))
    doubtful = read.withColumn("doubtful", _doubtful(F.col("items")))
    elements = F.when(F.col("doubtful"),
                      _array_of(T.ArrayType(T.StringType()), '["%s"]', lambda last: F.get(last, F.lit(0))))
    return doubtful.withColumn("elements", F.transform(elements, _element))


def parse_messages(messages: DataFrame) -> DataFrame:
    """One row per usable record; each inherits its message's publish time.

    An absent number is 0 and an absent ``success`` is a failure.  An element that is
    no object, has a field of the wrong type, or lacks job or operation, is left out
    here and shows up in ``quarantine``; its neighbours in the array are not affected.
    """
    usable = F.filter("elements", lambda e: _usable(e["record"]))
    repaired = F.transform(usable, lambda e: _typed(e["record"]))
    records = F.when(F.col("doubtful"), repaired).otherwise(F.col("items"))
    # The outer form keeps messages without records for a moment.  The plain form
    # has the optimizer test the array's size below, which reads every text twice.
    return (
        _with_items(messages).select("publish_time", records.alias("records"))
        .select("publish_time", F.inline_outer("records"))
        .where(F.col("job_id").isNotNull())
    )


def quarantine(messages: DataFrame) -> DataFrame:
    """What ``parse_messages`` leaves out, kept with the reason.

    A message that is no JSON array is one row with its whole text; an unusable
    element is one row with the element's text.
    """
    unreadable = F.col("doubtful") & F.col("elements").isNull()
    whole = F.array(F.col("data"))
    unusable = F.transform(F.filter("elements", lambda e: ~_usable(e["record"])),
                           lambda e: F.coalesce(e["text"], F.lit("null")))
    return (
        _with_items(messages)
        .select("publish_time", unreadable.alias("unreadable"),
                F.when(unreadable, whole).otherwise(unusable).alias("rejected"))
        .select("publish_time", "unreadable", F.posexplode_outer("rejected").alias("place", "payload"))
        .where(F.col("place").isNotNull())
        .select("publish_time", "payload",
                F.when(F.col("unreadable"), "message").otherwise("record").alias("rejected"))
    )


ACCEPTED, BAD_RECORD, BAD_MESSAGE = "accepted", "record", "message"


def split_messages(
    messages: DataFrame, read: Observation | None = None, kept: Observation | None = None
) -> DataFrame:
    """What ``parse_messages`` and ``quarantine`` give, from one reading of each text.

    A row per element: ``publish_time``, the ``outcome`` (accepted, or why it was not),
    the typed ``record`` of an accepted one and the ``payload`` of another.  ``read``
    observes messages and their elements before they are unfolded (an unreadable
    message is one), ``kept`` the rows of each outcome: their sums must agree.
    """
    def row(outcome: str, record: Column | None = None, payload: Column | None = None) -> Column:
        record = F.lit(None).cast(schemas.TRANSACTION) if record is None else record
        payload = F.lit(None).cast("string") if payload is None else payload
        return F.struct(F.lit(outcome).alias("outcome"), record.alias("record"), payload.alias("payload"))

    unreadable = F.col("doubtful") & F.col("elements").isNull()
    each = F.transform("elements", lambda e: F.when(_usable(e["record"]), row(ACCEPTED, _typed(e["record"])))
                       .otherwise(row(BAD_RECORD, payload=F.coalesce(e["text"], F.lit("null")))))
    rows = (
        F.when(unreadable, F.array(row(BAD_MESSAGE, payload=F.col("data"))))
        .when(F.col("doubtful"), each)
        .otherwise(F.transform("items", lambda r: row(ACCEPTED, r)))
    )
    held = F.when(unreadable, 1).when(F.col("doubtful"), F.size("elements")).otherwise(F.size("items"))
    found = _with_items(messages).select("publish_time", held.alias("held"), rows.alias("rows"))
    if read is not None:
        found = found.observe(read, F.count("*").alias("messages"),
                              F.coalesce(F.sum("held"), F.lit(0)).alias("elements"))
    found = found.select("publish_time", F.inline_outer("rows")).where(F.col("outcome").isNotNull())
    if kept is not None:
        found = found.observe(kept, *[
            F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in (ACCEPTED, BAD_RECORD, BAD_MESSAGE)])
    return found


def accepted_records(split: DataFrame) -> DataFrame:
    """The records of a split, as ``parse_messages`` gives them."""
    return split.where(F.col("outcome") == ACCEPTED).select("publish_time", "record.*")


def rejected_payloads(split: DataFrame) -> DataFrame:
    """The rejects of a split, as ``quarantine`` gives them."""
    return split.where(F.col("outcome") != ACCEPTED).select(
        "publish_time", "payload", F.col("outcome").alias("rejected"))


# The name of the field that closes an object's text; records of the schema lack it.
_CLOSING = "text_sha256"


def _with_object(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Messages with their object as ``record``: null if the text is not one JSON object
    that has every field of the schema with its type.

    The text is read once, as the first of two elements like an array's (see
    ``_array_of``).
    """
    if _CLOSING in schema.fieldNames():
        raise ValueError(f"a record may not have a field {_CLOSING}")
    closed = T.StructType([*schema.fields, T.StructField(_CLOSING, T.StringType())])
    wrapped = F.concat(F.lit("["), F.col("data"), F.lit(f',{{"{_CLOSING}":"'), _digest(), F.lit('"}]'))
    both = F.from_json(wrapped, T.ArrayType(closed))

    def whole(b: Column) -> Column:
        fits = (F.size(b) == 2) & (b[1][_CLOSING] == _digest())
        for name in schema.fieldNames():
            fits = fits & b[0][name].isNotNull()
        return F.when(fits, F.struct(*[b[0][name].alias(name) for name in schema.fieldNames()]))

    return messages.select(
        "publish_time", "data", F.transform(F.array(both), whole)[0].alias("record"))


def parse_objects(
    messages: DataFrame, schema: T.StructType = schemas.PROTOTYPE_TRANSACTION, strict: bool = True
) -> DataFrame:
    """One row per message that holds a single JSON object with all fields.

    ``strict`` fails the job on any other text; otherwise such messages are left out
    (and ``quarantine_objects`` keeps them).
    """
    read = _with_object(messages, schema)
    if strict:
        fault = F.raise_error(F.concat(F.lit("MALFORMED object: "), F.coalesce("data", F.lit("null"))))
        read = read.withColumn("record", F.coalesce("record", fault.cast(schema)))
    # Unfolding first keeps the filter above a stream's watermark, so a message that is
    # left out moves it all the same.
    return read.select("publish_time", F.inline_outer(F.array("record"))).where(
        F.col(schema.fieldNames()[0]).isNotNull())


def quarantine_objects(
    messages: DataFrame, schema: T.StructType = schemas.PROTOTYPE_TRANSACTION
) -> DataFrame:
    """Messages that are not one JSON object of the schema."""
    tested = F.struct(F.col("record").isNull().alias("rejected"), "data")
    # Unfolded, the test is a column: as a filter the optimizer would read the text again.
    return _with_object(messages, schema).select(
        "publish_time", F.inline_outer(F.array(tested))).where("rejected").select("publish_time", "data")


def batch_messages(
    records: DataFrame, interval: str = K.PUBLISH_INTERVAL, parts: int = 1
) -> DataFrame:
    """One JSON-array message per interval and publisher that has records.

    Publishers (``workload_id``) have queues of their own.  With ``parts`` every
    interval of every publisher is dealt into so many messages alike, by a hash of the
    record and the place where it is read, so copies are dealt out too.
    """
    fields = schemas.TRANSACTION.fieldNames()
    place = F.lit(0) if parts == 1 else F.pmod(
        F.xxhash64(*fields, F.monotonically_increasing_id()), F.lit(parts))
    slotted = records.select(
        F.window("publish_time", interval)["start"].alias("publish_time"),
        "workload_id", place.alias("part"), F.struct(*fields).alias("record"))
    return slotted.groupBy("publish_time", "workload_id", "part").agg(
        F.to_json(F.sort_array(F.collect_list("record"))).alias("data")).drop("part")


def compose_key(records: DataFrame) -> DataFrame:
    """Records keyed by one ``operation-job`` text, as older consumers expect."""
    return records.withColumn("key", F.concat("operation", F.lit("-"), "job_id"))


def decompose_key(keyed: DataFrame) -> DataFrame:
    """Replace a composed key by its action and job."""
    return keyed.withColumn("_k", timing.split_key(F.col("key"))).select("*", "_k.*").drop("_k")
