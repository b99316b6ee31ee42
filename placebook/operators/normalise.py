"""Three document shapes become one listing row per business.

A document is a list of businesses inside an object, the profile of one company, or a bare
list. All shapes go through the same projection and one explode, so a document is read and
parsed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.functions.once import once
from placebook.functions.truth import count_true, present_field, present_variant
from placebook.session import prepare

CONTACT_FIELDS = ["address", "phone", "website", "email"]
EXTRA_FIELDS = ["business_details", "key_contacts", "online_presence"]
LISTING_FIELDS = ["company_name", "city", "state", *CONTACT_FIELDS, "industry", "source_task"]


# What is read of a business element, of a profile, and of the envelope around a list. Where
# absent and null differ, or the JSON type matters, the member is kept as a variant.
_BUSINESS = (
    "struct<company_name string, city variant, state variant, "
    "address string, phone string, website string, email string>"
)
_PROFILE = (
    "struct<company_name string, "
    "location struct<city variant, state variant, address string>, "
    "contact struct<phone string, website string, email string>, "
    "business_details variant, key_contacts variant, online_presence variant>"
)
_ENVELOPE = "struct<city variant, state variant, industry variant, task_id variant>"


def member(value: str, path: str) -> str:
    """Member as a variant: null when absent, a variant null when it is there but null."""
    return f"variant_get({value}, '$.{path}', 'variant')"


def text_of(value: str) -> str:
    return f"variant_get({value}, '$', 'string')"


def text_or(value: str, default: str) -> str:
    """Text of a variant, or a default if it is absent; a variant null stays null."""
    return f"CASE WHEN {value} IS NULL THEN {default} ELSE {text_of(value)} END"


def _as(value: str, kind: str) -> str:
    return f"try_variant_get({value}, '$', '{kind}')"


def _is_object(value: str) -> str:
    return f"startswith(schema_of_variant({value}), 'OBJECT')"


def _not_text(value: str, text: str) -> str:
    """True when a variant is neither a string nor null nor absent.

    Only texts that read like a number, a truth value, a list or an object need a look at it.
    """
    return f"""coalesce(CASE WHEN substring({text}, 1, 1) IN
        ('-', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9', '[', '{{')
        OR {text} IN ('true', 'false') THEN schema_of_variant({value}) <> 'STRING' END, false)"""


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(value) for name, value in columns.items()})


def with_elements(documents: DataFrame) -> DataFrame:
    """One row per business element, with shape and the fields its envelope hands down.

    A document that fails as a whole gives one row with ``problem`` set. A document of no
    known shape or without elements gives one row without ``element``; it marks that the
    document was read.
    """
    before = "problem" if "problem" in documents.columns else "CAST(NULL AS STRING)"
    kept = [c for c in documents.columns if c not in ("v", "problem")]
    businesses = member("v", "businesses")
    staged = documents.selectExpr(
        *kept, "v", f"{before} AS problem",
        "try_variant_get(v, '$.businesses', 'array<variant>') AS listed",
    )
    staged = _with(staged, {
        "known": f"""CASE WHEN listed IS NOT NULL OR {businesses} IS NOT NULL THEN 'envelope'
            WHEN {member('v', 'company_name')} IS NOT NULL THEN 'profile' END"""
    })
    staged = _with(staged, {
        "bare": f"CASE WHEN known IS NULL THEN {_as('v', 'array<variant>')} END",
        "env": f"CASE WHEN known = 'envelope' THEN {_as('v', _ENVELOPE)} END",
    })
    staged = _with(staged, {
        "shape": "CASE WHEN bare IS NOT NULL THEN 'list' ELSE known END",
        "task_id": f"""CASE known WHEN 'envelope' THEN env.task_id
            WHEN 'profile' THEN {member('v', 'task_id')} END""",
    })
    enveloped = "CASE WHEN known = 'envelope' THEN {} ELSE {} END"
    handed = {
        "env_city": enveloped.format(text_or("env.city", "''"), "''"),
        "env_state": enveloped.format(text_or("env.state", "''"), "''"),
        "env_industry": enveloped.format(text_or("env.industry", "''"), "NULL"),
        "env_task": text_or("task_id", "file"),
    }
    staged = _with(staged, handed)

    # What follows THEN is computed for few documents only. Spark computes an expression that
    # occurs twice under AND ahead of it, for every row.
    def not_object(name: str) -> str:
        part = member("v", name)
        return f"""CASE WHEN known = 'profile'
            THEN {part} IS NOT NULL AND NOT {_is_object(part)} ELSE false END"""

    # An empty object or an empty string in place of the list simply holds no business.
    no_list = f"""CASE WHEN known = 'envelope' AND listed IS NULL
        THEN NOT startswith(schema_of_variant({businesses}), 'OBJECT<>')
            AND coalesce({text_of(businesses)}, '?') <> '' ELSE false END"""
    flags = {
        "bad_city": f"known = 'envelope' AND {_not_text('env.city', 'env_city')}",
        "bad_state": f"known = 'envelope' AND {_not_text('env.state', 'env_state')}",
        "has_industry": present_field("env.industry", "env_industry"),
        "has_task": f"""CASE WHEN task_id IS NULL THEN length(file) > 0
            ELSE {present_field('task_id', 'env_task')} END""",
        "problem": f"""CASE WHEN problem IS NOT NULL THEN problem
            WHEN {no_list} THEN 'businesses is not a list'
            WHEN {not_object('location')} THEN 'location is not an object'
            WHEN {not_object('contact')} THEN 'contact is not an object' END""",
        "elements": "CASE WHEN known = 'profile' THEN array(v) ELSE coalesce(listed, bare) END",
    }
    staged = _with(staged, flags)
    return staged.selectExpr(
        *kept, "problem", "shape", *handed, "bad_city", "bad_state", "has_industry", "has_task",
        "posexplode_outer(CASE WHEN problem IS NULL THEN elements END) AS (pos, element)",
    )


def normalise(documents: DataFrame) -> DataFrame:
    """Listing rows of ``(file, v[, problem])`` documents.

    Result: the nine listing fields, ``extra`` (nested attributes of a profile), ``filled``
    (number of present values), ``file`` and ``pos`` (where it was seen), ``first`` (marks the
    one row that stands for its document), ``is_business`` and ``problem``. Rows with a problem
    and rows without a business are kept here; see ``listings`` and ``rejected``.
    """
    prepare(documents.sparkSession)
    rows = _with(with_elements(documents), {
        "profile": f"CASE WHEN shape = 'profile' THEN {_as('element', _PROFILE)} END",
        "business": f"CASE WHEN shape <> 'profile' THEN {_as('element', _BUSINESS)} END",
    })
    passed = [c for c in documents.columns if c not in ("v", "problem")]
    handed = [c for c in rows.columns if c.startswith(("env_", "bad_", "has_"))]
    home = {"address": "location", "phone": "contact", "website": "contact", "email": "contact"}
    typed = rows.selectExpr(
        *passed, *handed, "shape", "problem", "pos", "element",
        "coalesce(shape = 'profile', false) AS is_profile",
        "coalesce(profile.company_name, business.company_name) AS company_name",
        "coalesce(profile.location.city, business.city) AS own_city",
        "coalesce(profile.location.state, business.state) AS own_state",
        *[f"coalesce(profile.{home[c]}.{c}, business.{c}) AS {c}" for c in CONTACT_FIELDS],
        *[f"profile.{name} AS {name}" for name in EXTRA_FIELDS],
    )
    typed = _with(typed, {
        "city": text_or("own_city", "env_city"), "state": text_or("own_state", "env_state")
    })

    def has_contact(name: str) -> str:
        own = f"""CASE WHEN is_profile THEN {member('element', f'{home[name]}.{name}')}
            ELSE {member('element', name)} END"""
        return present_field(own, name)

    def bad_place(name: str) -> str:
        return f"""CASE WHEN own_{name} IS NULL THEN bad_{name}
            ELSE {_not_text(f'own_{name}', name)} END"""

    name = member("element", "company_name")
    has_name = present_field(name, "company_name")
    # Rows whose name or place is no text are rejected, so places count as texts.
    truths = [has_name, "coalesce(city <> '', false)", "coalesce(state <> '', false)"]
    truths += [has_contact(field) for field in CONTACT_FIELDS]
    truths += ["has_industry", "has_task"]
    truths += [present_variant(field) for field in EXTRA_FIELDS]
    scored = _with(typed, {
        "named": f"element IS NOT NULL AND (is_profile OR {has_name})",
        "filled": count_true(truths),
        "stray": f"""element IS NOT NULL AND shape = 'envelope' AND company_name IS NULL
            AND NOT {_is_object('element')}""",
        "bad_name": f"company_name IS NULL OR {_not_text(name, 'company_name')}",
        "bad_city": bad_place("city"),
        "bad_state": bad_place("state"),
    })
    final = {name: name for name in ("company_name", "city", "state", *CONTACT_FIELDS)}
    final |= {"industry": "env_industry", "source_task": "env_task"}
    final["extra"] = f"CASE WHEN is_profile THEN struct({', '.join(EXTRA_FIELDS)}) END"
    final |= {"filled": "filled"} | {name: name for name in passed}
    final |= {"pos": "coalesce(pos, 0)", "first": "coalesce(pos, 0) = 0", "is_business": "named"}
    final["problem"] = """CASE WHEN problem IS NOT NULL THEN problem
        WHEN stray THEN 'business is not an object'
        WHEN named AND bad_name THEN 'company_name is not a text'
        WHEN named AND bad_city THEN 'city is not a text'
        WHEN named AND bad_state THEN 'state is not a text' END"""
    return once(scored, **final)


def listings(normalised: DataFrame) -> DataFrame:
    """The rows that are businesses."""
    return normalised.where("is_business AND problem IS NULL").drop(
        "first", "is_business", "problem"
    )


def rejected(normalised: DataFrame) -> DataFrame:
    """``(file, pos, problem)`` of documents and elements that could not be used."""
    return normalised.where("problem IS NOT NULL").select("file", "pos", "problem")
