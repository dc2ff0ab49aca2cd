"""Address-book people, contact lookups and handle resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chatlake.functions import contact as C
from chatlake.functions.text import present
from chatlake.operators.keys import drop_keys, keep_keys
from chatlake.operators.lookups import USER_COLUMNS
from chatlake.operators.sequences import PART_ROWS, collect_parts

PERSON = ["source", "z_pk"]


def _or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def named(record: DataFrame) -> DataFrame:
    return record.where("first_name IS NOT NULL OR last_name IS NOT NULL")


def _owned(points: DataFrame, value: str) -> DataFrame:
    return points.select("source", F.col("owner").alias("z_pk"), value)


def scan_contacts(record: DataFrame, phone: DataFrame, email: DataFrame) -> DataFrame:
    """Every contact point of every source, one row each; people without one keep a row."""
    points = _owned(phone, "full_number").select(*PERSON, F.lit("phone").alias("kind"), F.col("full_number").alias("value"))
    points = points.unionByName(
        _owned(email, "address").select(*PERSON, F.lit("email").alias("kind"), F.col("address").alias("value"))
    )
    return record.join(points.where("value IS NOT NULL"), PERSON, "left")


def person_rows(record: DataFrame, phone: DataFrame, email: DataFrame) -> DataFrame:
    """Distinct (person, phone, e-mail) rows of people with a name part."""
    rows = named(record).join(_owned(phone, "full_number"), PERSON, "left").join(_owned(email, "address"), PERSON, "left")
    return rows.select(*PERSON, "first_name", "last_name", "full_number", "address").distinct()


def person_contacts(record: DataFrame, phone: DataFrame, email: DataFrame) -> DataFrame:
    """One row per distinct phone or lower-case e-mail of a person."""
    phones = _owned(phone, "full_number").where(present(F.col("full_number"))).select(
        *PERSON, F.lit("phone").alias("kind"), F.col("full_number").alias("value"))
    emails = _owned(email, "address").where(present(F.col("address"))).select(
        *PERSON, F.lit("email").alias("kind"), F.lower("address").alias("value"))
    points = phones.unionByName(emails).distinct()
    people = named(record).select(*PERSON, _or_empty("first_name").alias("first_name"),
                                  _or_empty("last_name").alias("last_name"))
    return people.join(points, PERSON)


def person_contact_sets(record: DataFrame, phone: DataFrame, email: DataFrame,
                        part_rows: int = PART_ROWS) -> DataFrame:
    """The sorted set of phones and of e-mails of each person, ``part_rows`` to a row."""
    points = person_contacts(record, phone, email)
    return collect_parts(points, [*PERSON, "first_name", "last_name", "kind"], ["value"], F.col("value"), "values",
                         part_rows)


def extract_contacts(record: DataFrame, phone: DataFrame, email: DataFrame) -> DataFrame:
    """One row per distinct person: smallest phone and e-mail; nameless or unreachable people dropped.

    ``load_order`` is where the person first appeared.
    """
    phones = _owned(phone, "full_number").where(present(F.col("full_number")))
    phones = phones.groupBy(*PERSON).agg(F.min("full_number").alias("_phone"))
    emails = _owned(email, "address").where(present(F.col("address")))
    emails = emails.groupBy(*PERSON).agg(F.min(F.lower("address")).alias("_email"))
    people = named(record).join(phones, PERSON, "left").join(emails, PERSON, "left").select(
        _or_empty("first_name").alias("first_name"), _or_empty("last_name").alias("last_name"),
        C.normalize_phone(F.col("_phone")).alias("phone_number"), _or_empty("_email").alias("email"),
        F.struct(*PERSON).alias("_at"),
    )
    key = ["first_name", "last_name", "phone_number", "email"]
    kept = people.where("(first_name <> '' OR last_name <> '') AND (phone_number <> '' OR email <> '')")
    unique = kept.groupBy(*key).agg(F.min("_at").alias("load_order"))
    user_id = F.md5(F.concat_ws(":", F.lit("contact"), *key))
    return unique.select(user_id.alias("user_id"), *key, F.lit(None).cast("bigint").alias("handle_id"), "load_order")


def union_sources_dedup(*books: DataFrame) -> DataFrame:
    """Union of extracted address books, one row per name, phone and e-mail."""
    merged = books[0]
    for book in books[1:]:
        merged = merged.unionByName(book)
    key = ["first_name", "last_name", "phone_number", "email"]
    return merged.groupBy(*key).agg(F.min("load_order").alias("load_order"))


def last_wins(contacts: DataFrame, key: Column) -> DataFrame:
    """key -> names of the contact loaded last."""
    keyed = contacts.select(key.alias("key"), "first_name", "last_name", "load_order").where(present(F.col("key")))
    # Names break ties so that the result does not depend on the row order.
    latest = F.max(F.struct("load_order", "first_name", "last_name")).alias("_latest")
    return keyed.groupBy("key").agg(latest).select("key", "_latest.first_name", "_latest.last_name")


def _phone_key(phone: Column) -> Column:
    return F.concat(F.lit("phone:"), phone)


def _email_key(email: Column) -> Column:
    return F.concat(F.lit("email:"), email)


def contact_keys(contacts: DataFrame) -> DataFrame:
    """Names by ten-digit phone and by e-mail, in one lookup with prefixed keys."""
    email = C.normalize_email(F.col("email"))
    keys = F.array(_phone_key(C.phone_from_handle(F.col("phone_number"))),
                   _email_key(F.when(present(email), email)))
    keyed = contacts.select("first_name", "last_name", "load_order", F.explode(keys).alias("_key"))
    return last_wins(keyed, F.col("_key"))


def handle_user_id(handle_id: Column) -> Column:
    """The same handle always gives the same user."""
    return F.md5(F.concat(F.lit("handle:"), handle_id.cast("string")))


def resolve_handles(handle: DataFrame, contacts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One user per handle and how it was found.

    Order of preference: a user that already has the handle, a contact with that
    phone, a contact with that e-mail, a user made of the handle alone.
    """
    lookup = contact_keys(contacts)
    value = F.col("id")
    # Both joins read the same lookup, so it is computed and exchanged once.
    by_phone = lookup.select(F.col("key").alias("_pk"), F.struct("first_name", "last_name").alias("_by_phone"))
    by_email = lookup.select(F.col("key").alias("_ek"), F.struct("first_name", "last_name").alias("_by_email"))
    probes = handle.select("handle_id", "id").where(present(value)).withColumns({
        "_is_phone": C.looks_like_phone(value), "_is_email": C.looks_like_email(value),
    }).withColumns({
        "_phone": F.when(F.col("_is_phone"), C.phone_from_handle(value)),
        "_email": F.when(F.col("_is_email"), C.normalize_email(value)),
    })
    found = probes.join(by_phone, _phone_key(F.col("_phone")) == F.col("_pk"), "left")
    found = found.join(by_email, _email_key(F.col("_email")) == F.col("_ek"), "left")

    kind = F.when(F.col("_pk").isNotNull(), "phone").when(F.col("_ek").isNotNull(), "email").otherwise("fallback")
    # The handle's own value is its phone when it looks like one, or has digits and is no address.
    as_phone = F.col("_is_phone") | (~F.col("_is_email") & C.has_digit(value))
    found = found.withColumns({
        "match_kind": kind, "_contact": F.coalesce("_by_phone", "_by_email"),
        "_point": F.when(F.col("_pk").isNotNull(), "phone").when(F.col("_ek").isNotNull(), "email")
        .when(as_phone, "phone").otherwise("email"),
    })
    resolved = found.select(
        handle_user_id(F.col("handle_id")).alias("user_id"),
        _or_empty("_contact.first_name").alias("first_name"), _or_empty("_contact.last_name").alias("last_name"),
        F.when(F.col("_point") == "phone", F.coalesce("_phone", value)).otherwise("").alias("phone_number"),
        F.when(F.col("_point") == "email", value).otherwise("").alias("email"), "handle_id", "match_kind",
    )
    if existing is None:
        return resolved
    taken = one_user_per_handle(existing)
    kept = keep_keys(taken, handle, ["handle_id"]).select(*USER_COLUMNS, F.lit("existing").alias("match_kind"))
    return drop_keys(resolved, taken, ["handle_id"]).unionByName(kept)


def resolve_handle_ids(handle_ids: DataFrame, handle: DataFrame, contacts: DataFrame,
                       existing: DataFrame | None = None) -> DataFrame:
    """Resolve handles known by id only; an id without a handle gives no row."""
    return resolve_handles(keep_keys(handle, handle_ids, ["handle_id"]), contacts, existing)


def one_user_per_handle(users: DataFrame) -> DataFrame:
    rest = [c for c in USER_COLUMNS if c != "handle_id"]
    linked = users.where("handle_id IS NOT NULL").groupBy("handle_id")
    return linked.agg(F.min(F.struct(*rest)).alias("_user")).select("_user.*", "handle_id").select(USER_COLUMNS)


def build_users(handle: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contact users (no handle) and one user per handle."""
    resolved = resolve_handles(handle, contacts)
    return contacts.select(USER_COLUMNS).unionByName(resolved.select(USER_COLUMNS))


def contact_lookup(record: DataFrame, phone: DataFrame, email: DataFrame) -> DataFrame:
    """(phone digits or lower-case e-mail) -> name over all sources, last writer wins."""
    names = record.select(*PERSON, "first_name", "last_name")
    phones = phone.select("source", F.col("owner").alias("z_pk"), C.phone_digits(F.col("full_number")).alias("key"),
                          F.struct("source", F.lit(0).alias("kind"), "point_id").alias("_at"))
    emails = email.select("source", F.col("owner").alias("z_pk"), F.lower("address").alias("key"),
                          F.struct("source", F.lit(1).alias("kind"), "point_id").alias("_at"))
    points = phones.unionByName(emails).where(present(F.col("key"))).join(names, PERSON)
    latest = points.groupBy("key").agg(F.max(F.struct("_at", "first_name", "last_name")).alias("_last"))
    first, last = F.col("_last.first_name"), F.col("_last.last_name")
    return latest.select("key", first.alias("first_name"), last.alias("last_name"),
                         C.full_name(first, last).alias("full_name"))


def lookup_cascade(handle: DataFrame, lookup: DataFrame) -> DataFrame:
    """Names for each handle: by raw value, by phone digits, by lower case; first hit wins."""
    value = F.col("id")
    rows = handle.withColumns({
        "_k0": F.when(present(value), value),
        "_k1": F.when(C.has_digit(value), C.phone_digits(value)),
        "_k2": F.lower(value),
    })
    for i in range(3):
        side = lookup.select(F.col("key").alias(f"_key{i}"),
                             F.struct("first_name", "last_name", "full_name").alias(f"_hit{i}"))
        rows = rows.join(side, F.col(f"_k{i}") == F.col(f"_key{i}"), "left")
    hit = F.coalesce("_hit0", "_hit1", "_hit2")
    return rows.select(
        *handle.columns, hit["first_name"].alias("contact_first_name"),
        hit["last_name"].alias("contact_last_name"), hit["full_name"].alias("contact_full_name"),
    )


# Reports.

def _distinct_rows(record: DataFrame, phone: DataFrame, email: DataFrame) -> DataFrame:
    """How many distinct (first name, last name, phone, e-mail) rows people have, as ``unique_contacts``.

    Phones x e-mails are not built: a phone that one person of a name holds stands in as
    many rows as that person has e-mails. Only phones that namesakes share are joined
    with the e-mails of all who hold them.
    """
    name = ["first_name", "last_name"]
    people = named(record).select(*PERSON, *name)
    phones = people.join(_owned(phone, "full_number"), PERSON, "left").distinct()
    emails = people.join(_owned(email, "address"), PERSON, "left").distinct()
    # The number of holders and, for a single one, who it is.
    holders = phones.groupBy(*name, "full_number").agg(
        F.count(F.lit(1)).alias("holders"), F.min(F.struct(*PERSON)).alias("holder"))
    sizes = emails.groupBy(*PERSON, *name).agg(F.count(F.lit(1)).alias("addresses"))
    single = holders.where("holders = 1").select("holder.*", *name).join(
        sizes.select(*PERSON, "addresses", *[F.col(c).alias(f"_{c}") for c in name]), PERSON).where(
            _same_names(name)).agg(F.coalesce(F.sum("addresses"), F.lit(0)))
    shared = holders.where("holders > 1").select(*[F.col(c).alias(f"_{c}") for c in (*name, "full_number")])
    among = phones.join(shared, _same_names([*name, "full_number"])).select(*PERSON, *name, "full_number")
    addresses = emails.select(*PERSON, *[F.col(c).alias(f"_{c}") for c in name], "address")
    several = among.join(addresses, PERSON).where(_same_names(name)).select(
        *name, "full_number", "address").distinct().agg(F.count(F.lit(1)).alias("rows"))
    return several.select((F.col("rows") + single.scalar()).alias("unique_contacts"))


def _same_names(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])


def extraction_stats(record: DataFrame, phone: DataFrame, email: DataFrame) -> DataFrame:
    """Sources, named records, records with a phone / e-mail, distinct contact rows."""
    people = named(record).groupBy(*PERSON).agg(F.count(F.lit(1)).alias("rows"))
    for points, flag in ((phone, "has_phone"), (email, "has_email")):
        owners = points.select("source", F.col("owner").alias("z_pk")).distinct().withColumn(flag, F.lit(1))
        people = people.join(owners, PERSON, "left")
    return people.agg(
        F.countDistinct("source").alias("total_databases"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_records"),
        F.count("has_phone").alias("records_with_phone"), F.count("has_email").alias("records_with_email"),
    ).select("*", _distinct_rows(record, phone, email).scalar().alias("unique_contacts"))


def name_completeness(record: DataFrame, phone: DataFrame, email: DataFrame) -> DataFrame:
    """People with a contact point by which name parts they have, per source."""
    reachable = phone.where("full_number IS NOT NULL").select("source", F.col("owner").alias("z_pk")).unionByName(
        email.where("address IS NOT NULL").select("source", F.col("owner").alias("z_pk")))
    people = keep_keys(record, reachable, PERSON).dropDuplicates(PERSON)
    first, last = F.col("first_name"), F.col("last_name")
    return people.groupBy("source").agg(
        F.count_if(first.isNotNull() & ~present(last)).alias("first_only"),
        F.count_if(~present(first) & last.isNotNull()).alias("last_only"),
        F.count_if(first.isNotNull() & last.isNotNull()).alias("both_names"),
    )
