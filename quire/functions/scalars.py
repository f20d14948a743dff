"""Scalar rules: flags, label rules, names, vectors, number formats."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The document types that composition statistics track; all others count as "Other".
TRACKED_TYPES = [
    "Approval notice",
    "D.1",
    "D.2",
    "DM.1",
    "Judicial and political background check",
    "NAMA agreement",
    "Registration card",
    "Report of selection and medical officers",
    "Testimonial labour (Qualification & Employment Proof)",
    "Testimonial medical form (Medical & Health Documents)",
    "Testimonial medical letter (Medical & Health Documents)",
]
OTHER = "Other"

# Label rules, tried in this order: test, text, resulting label (None: the label itself).
LABEL_RULES: list[tuple[str, str, str | None]] = [
    ("starts", "Letter about procedure", "Letter about procedure"),
    ("starts", "Letter testimonial", "Testimonial status (Application Documents)"),
    ("starts", "Testimonial", "Testimonial status (Application Documents)"),
    ("starts_any_case", "consent", "Testimonial status (Application Documents)"),
    ("starts_any_case", "divorce", "Testimonial status (Application Documents)"),
    ("starts_any_case", "letter", "Letter (Other)"),
    ("has", "proof", "Testimonial status (Application Documents)"),
    ("is", "D2 (predecessor model 60)", "D.2"),
    ("starts", "Form ", None),
    ("is", "Trade Pro forma", "Form No. 136 (Trade Pro Forma)"),
    ("is", "Nominal Roll (excerpt)", "Form (Other)"),
    ("is", "Onbekend", "Form (Other)"),
    ("is", "check required of period in germany", "Letter about procedure (Security & Political Screening Documents)"),
    ("is", "Information on Professional Qualifications in the Netherlands", "Form No. 63 (Rijksarbeidsbureau - Qualifications)"),
    ("is", "Service Declaration", "Testimonial labour (Qualification & Employment Proof)"),
    ("is", "Report selection officer XS (Landing Permit)", "Report of selection and medical officers"),
    ("has_any_case", "certificate", "Testimonial status (Application Documents)"),
    ("is", "medical officers advise", "Report of selection and medical officers"),
    ("is", "telegram asking for health check", "Letter about procedure (Medical & Health Documents)"),
    ("is", "telegram notification", "Letter about procedure (Medical & Health Documents)"),
]
LABEL_DEFAULT = "Letter (Other)"

# How backbones are printed.
BACKBONE_NAMES = {
    "facebook/dinov2-small": "DINOv2-S",
    "microsoft/dit-large-finetuned-rvlcdip": "DiT-Large",
    "sentence-transformers/paraphrase-multilingual-mpnet-base-v2": "mpnet-multilingual",
    "bert-base-uncased": "BERT-base",
    "vgg16": "VGG16",
    "efficientnet_b0": "EfficientNet-B0",
    "efficientnet": "EfficientNet-B0",
}
# Model name prefixes, their regime and algorithm.
NAME_PREFIXES = [
    ("knn-", "baseline", "KNN"),
    ("xgboost-", "baseline", "XGBoost"),
    ("lstm-", "sequence", "LSTM"),
    ("early-fusion-", "fusion", "Early fusion"),
    ("late-fusion-", "fusion", "Late fusion"),
    ("bert-ft-", "finetune", "BERT fine-tune"),
]


def is_start(flag: Column, rule: str = "trim") -> Column:
    """Whether a page starts a document, never null. trim: white space and case don't count; lower: case doesn't; exact: 'yes' only."""
    if rule == "trim":
        flag = F.lower(F.regexp_replace(flag, r"^\s+|\s+$", ""))
    elif rule == "lower":
        flag = F.lower(flag)
    elif rule != "exact":
        raise ValueError(rule)
    return F.coalesce(flag == "yes", F.lit(False))


def tracked(label: Column, types: Iterable[str] = TRACKED_TYPES) -> Column:
    """The label if it is tracked, else (null too) Other."""
    return F.when(label.isin(*types), label).otherwise(OTHER)


def by_rules(label: Column, rules: list[tuple[str, str, str | None]] = LABEL_RULES, default: str = LABEL_DEFAULT) -> Column:
    """The result of the first rule that holds. A null label has none."""
    small = F.lower(label)
    test = {
        "starts": lambda x: label.startswith(x), "starts_any_case": lambda x: small.startswith(x), "has": lambda x: label.contains(x),
        "has_any_case": lambda x: small.contains(x), "is": lambda x: label == x,
    }
    out = F.lit(default)
    for kind, text, result in reversed(rules):
        out = F.when(test[kind](text), label if result is None else F.lit(result)).otherwise(out)
    return F.when(label.isNotNull(), out)


def relabelled(document: Column, layout: Column, functional: Column) -> tuple[Column, Column, Column]:
    """(document, layout, functional) after the three rules that depend on each other: layout first, then functional, then document."""
    letter = document.startswith("Letter") | document.startswith("Testimonial")
    layout = F.when((layout == "Other") & letter, "Letter").otherwise(layout)
    procedure = F.coalesce(document.startswith("Letter about procedure"), F.lit(False))
    internal = (document == "Other") & (layout == "Other") & (functional == "Administrative & Internal Processing Documents")
    functional = F.when(procedure | internal, "Other").otherwise(functional)
    other = F.concat(F.lit("Other ("), layout, F.lit(", "), functional, F.lit(")"))
    return F.when(procedure, "Letter about procedure").when(document == "Other", other).otherwise(document), layout, functional


def casefolded(text: Column) -> Column:
    """Trimmed and in small letters, sharp s as ss: what spellings of a label have in common."""
    return F.lower(F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("ß"), F.lit("ss")))


def confidence(p: Column) -> Column:
    """Of a yes/no prediction with probability p of yes; null for a null p."""
    return F.when(p.isNotNull(), F.greatest(p, 1 - p))


def argmax(probs: Column) -> Column:
    """The first place (from 0) of the largest value; null for null or empty arrays."""
    return F.when(F.size(probs) > 0, F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once: inside the lambdas of a body it would be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def softmax(scores: Column) -> Column:
    def shares(e):
        return bound(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda x: x / total))

    return bound(F.array_max(scores), lambda high: bound(F.transform(scores, lambda x: F.exp(x - high)), shares))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    return bound(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x).cast("double")))


def path_of(root: str, pdf: Column, page: Column, extension: str, folder: str = "") -> Column:
    """root/folder/pdf/pdf_0001.ext"""
    parts = [F.lit(root.rstrip("/")), *([F.lit(folder)] if folder else []), pdf, F.concat(pdf, F.format_string("_%04d", page.cast("int")), F.lit("." + extension))]
    return F.concat_ws("/", *parts)


def annotation_paths(dossier: Column, page: Column, roots: dict[str, str]) -> dict[str, Column]:
    """A column for each kind of file in ``roots`` (image, text, markdown, pagexml): where an annotated page's lies."""
    number = F.format_string("page_%04d", page.cast("int"))
    own = F.concat(dossier, F.lit("_"), number)
    # The folders and suffixes.
    names = {"image": [F.concat(own, F.lit(".png"))], "text": [F.concat(own, F.lit(".txt"))], "markdown": [F.concat(own, F.lit(".markdown.md"))],
             "pagexml": [F.lit("page"), F.concat(number, F.lit(".xml"))]}
    return {f"{kind}_path": F.concat_ws("/", F.lit(root.rstrip("/")), dossier, *names[kind]) for kind, root in roots.items()}


def transcription_path(path: Column, old: str = "annotations", new: str = "transcriptions", extension: str = "xml") -> Column:
    """The mirrored path: one folder name exchanged, another suffix."""
    return F.concat(F.regexp_replace(F.replace(path, F.lit(f"/{old}/"), F.lit(f"/{new}/")), r"\.[^./]*$", ""), F.lit("." + extension))


def identifier(dossier: Column) -> Column:
    """What stands after the last dash."""
    return F.element_at(F.split(dossier, "-"), -1)


def era(year: Column, border: int = 1956) -> tuple[Column, Column]:
    """(1 from the border year on, else 0; years since the border)"""
    return (year >= border).cast("int"), year - border


def age_groups(persons: Column, adults16: Column, adults18: Column) -> tuple[Column, Column, Column]:
    """(adults of 18 or more, 16 and 17, under 16). Negative groups raise an error."""
    groups = adults18, adults16 - adults18, persons - adults16
    ok = (groups[1] >= 0) & (groups[2] >= 0)
    return tuple(F.when(F.assert_true(ok, F.lit("negative age group")).isNull(), g) for g in groups)


def percent(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull() | F.isnan(x), "-").otherwise(F.format_string(f"%.{digits}f%%", x * 100))


def number(x: Column, digits: int = 3) -> Column:
    return F.when(x.isNull() | F.isnan(x), "-").otherwise(F.format_string(f"%.{digits}f", x))


def interval(low: Column, high: Column, digits: int = 2) -> Column:
    return F.format_string(f"[%.{digits}f, %.{digits}f]", low, high)


def slug(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("__"))


def model_name(kind: str, *backbones: Column) -> Column:
    """kind-first+second with slashes slugged."""
    return F.concat(F.lit(kind + "-"), F.concat_ws("+", *[slug(b) for b in backbones]))


def parsed_model(name: Column) -> Column:
    """struct(regime, algo, backbones as printed) of a model's name."""
    regime, algo, rest = F.lit("other"), F.lit(""), name
    tuned = name.endswith("-ft")
    regime, algo = F.when(tuned, "finetune").otherwise(regime), F.when(tuned, "Fine-tune").otherwise(algo)
    rest = F.when(tuned, F.regexp_replace(name, "-ft$", "")).otherwise(rest)
    for prefix, r, a in reversed(NAME_PREFIXES):
        hit = name.startswith(prefix)
        regime, algo = F.when(hit, r).otherwise(regime), F.when(hit, a).otherwise(algo)
        rest = F.when(hit, F.substring(name, F.lit(len(prefix) + 1), F.length(name))).otherwise(rest)
    names = F.create_map(*[F.lit(x) for kv in BACKBONE_NAMES.items() for x in kv])
    pretty = F.transform(F.split(rest, r"\+"), lambda b: F.coalesce(F.try_element_at(names, F.replace(b, F.lit("__"), F.lit("/"))), F.replace(b, F.lit("__"), F.lit("/"))))
    return F.struct(regime.alias("regime"), algo.alias("algo"), pretty.alias("backbones"))
