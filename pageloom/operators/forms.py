"""Forms and their fields."""

from __future__ import annotations

from pageloom.functions.core import each, each_indexed, keep, non_empty, struct, text_map
from pageloom.functions.text import truncate_sql
from pageloom.operators.items import DOCUMENT, item

NAME, TYPE, TAGS = "forms", "form", ("form",)
# what to look for inside a form: the form itself comes first
INSIDE = {"form": ("form", "input", "select", "textarea")}


def _attr(e: str, name: str) -> str:
    return f"coalesce({e}.attrs['{name}'], '')"


def field_sql(e: str) -> str:
    """``tag[name=..,type=..(,value=..)(,placeholder=..)]``"""

    def optional(name: str) -> str:
        value = _attr(e, name)
        return f"IF({value} = '', '', concat(',{name}=', {truncate_sql(value, 50)}))"

    return (
        f"concat({e}.tag, '[name=', {_attr(e, 'name')}, ',type=', {_attr(e, 'type')},"
        f" {optional('value')}, {optional('placeholder')}, ']')"
    )


def described_sql() -> str:
    """array<struct<pos, method, action, enctype, name, id, fields>>, fields as
    array<struct<tag, attrs, label>>. A field without a name counts only in a
    form with an id."""

    # a nested form tag is none, so every element but the first is a field
    parts = each(
        f"{DOCUMENT}.form",
        lambda f: struct(form=f"get({f}, 0)", fields=f"filter({f}, e -> e.tag != 'form')"),
    )

    def form(x: str, i: str) -> str:
        counted = keep(
            f"{x}.fields",
            lambda e: f"{_attr(e, 'name')} != '' OR {_attr(f'{x}.form', 'id')} != ''",
        )
        return struct(
            pos=i,
            method=f"upper(coalesce({non_empty(_attr(f'{x}.form', 'method'))}, 'GET'))",
            action=_attr(f"{x}.form", "action"),
            enctype=_attr(f"{x}.form", "enctype"),
            name=_attr(f"{x}.form", "name"),
            id=_attr(f"{x}.form", "id"),
            fields=each(counted, lambda e: struct(tag=f"{e}.tag", attrs=f"{e}.attrs", label=field_sql(e))),
        )

    return each_indexed(parts, form)


def items_sql() -> str:
    def form_item(x: str) -> str:
        n = f"size({x}.fields)"
        value = (
            f"concat('FORM#', {x}.pos + 1, ' ', {x}.method, ' ', {x}.action, ' (', {n}, ' inputs)')"
        )
        labels = f"array_join(transform({x}.fields, f -> f.label), ' | ')"
        return item(
            TYPE,
            value,
            text_map(
                method=f"{x}.method",
                input_count=f"CAST({n} AS STRING)",
                action=non_empty(f"{x}.action"),
                enctype=non_empty(f"{x}.enctype"),
                name=non_empty(f"{x}.name"),
                id=non_empty(f"{x}.id"),
                inputs=f"IF({n} > 0, {labels}, NULL)",
            ),
            0,
            f"{x}.pos",
        )

    return each(described_sql(), form_item)
