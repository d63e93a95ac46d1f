"""Errors of argument checks."""


class ValidationError(ValueError):
    """An argument is outside its documented bounds."""


def bounded(name: str, value: int, low: int, high: int) -> int:
    """``value``, checked to be an integer between the bounds."""
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValidationError(f"{name} must be an integer from {low} to {high}")
    return value


def extraction(config: dict) -> dict:
    """``config`` of a structured extraction, checked: css_schema and xpath_schema need a base selector and fields,
    regex needs built-in patterns or custom ones. Extraction by a language model is not offered here."""
    kind = config.get("type")
    if kind in ("css_schema", "xpath_schema"):
        schema = config.get("schema") or {}
        if not (schema.get("baseSelector") or "").strip():
            raise ValidationError(f"{kind} needs schema.baseSelector")
        if not isinstance(schema.get("fields"), list) or not schema["fields"]:
            raise ValidationError(f"{kind} needs schema.fields with at least one field")
    elif kind == "regex":
        if not config.get("patterns") and not config.get("customPatterns"):
            raise ValidationError("regex needs patterns or customPatterns")
    else:
        raise ValidationError("type must be one of css_schema, xpath_schema, regex")
    return config


def exactly_one(**values) -> str:
    """The one name whose value is given."""
    given = [k for k, v in values.items() if v is not None]
    if len(given) != 1:
        raise ValidationError(f"exactly one of {', '.join(values)} must be given")
    return given[0]
