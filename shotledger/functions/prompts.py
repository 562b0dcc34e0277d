"""What a prompt's edit means: mask queries, text pairs, short references, phrases by attribute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotledger.functions.scalars import article, filled, listed

#: Tasks without an edited region, tasks without a direction in text, anchors of tasks without an entity.
UNMASKED, UNDIRECTED = ("T3", "T5", "T6", "T7"), ("T5", "T7")
ANCHORS = {"T3": "the original natural realistic scene", "T6": "the original camera framing of the scene"}
ANY_ANCHOR = "the original scene"
#: The rise of a score that counts as full, by task.
DELTA_MAX = {"T1": 0.05, "T2": 0.02, "T3": 0.05, "T4": 0.02, "T6": 0.03}
#: Words of a description, in order, and how its subject is called.
SUBJECTS = (
    ("barber", "the barber"), ("mechanic", "the mechanic"), ("hiker", "the hiker"), ("doctor", "the doctor"), ("teacher", "the teacher"), ("waiter", "the waiter"), ("retriever", "the dog"), ("girl", "the girl"), ("boy", "the boy"),
    ("elderly woman", "the elderly woman"), ("older woman", "the older woman"), ("older man", "the older man"), ("young woman", "the young woman"), ("young man", "the young man"), ("muscular man", "the muscular man"),
    ("athletic woman", "the athletic woman"), ("woman", "the woman"), ("man", "the man"),
)
ANYONE = "the person"
#: Words before a garment, and marks that name a person without one.
WORN = ("wearing a ", "wearing an ", "in a ")
MARKS = (("beard", " with the beard"), ("glasses", " with glasses"), ("ponytail", " with the ponytail"), ("pigtails", " with pigtails"))


def entity_description(characters: Column, entity: Column) -> Column:
    """desc of the first character with that id that has one; null if there is none."""
    return F.get(F.filter(characters, lambda c: (c["id"] == entity) & (F.coalesce(c["desc"], F.lit("")) != "")), 0)["desc"]


def _listed(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda v: F.coalesce(v, F.lit("")) != "")


def mask_policy(task: Column, description: Column, op: Column, old: Column, new: Column, target: Column) -> Column:
    """Where an edit shows, for prompts that don't say: nep_applicable, edit_type, source_queries, edited_queries.

    Tasks of the whole picture have no region; then the entity's description counts; then, for objects, what is taken
    and what is put; then the target phrase.
    """
    none = F.array().cast("array<string>")
    takes, puts = op.isin("replace", "delete", "remove"), op.isin("add", "replace")
    policy = lambda ok, kind, source, edited: F.struct(F.lit(ok).alias("nep_applicable"), kind.alias("edit_type"), source.alias("source_queries"), edited.alias("edited_queries"))
    objects = policy(True, F.concat(F.lit("legacy_object"), F.coalesce(F.concat(F.lit("_"), F.nullif(op, F.lit(""))), F.lit(""))), F.when(takes, _listed(old)).otherwise(none), F.when(puts, _listed(new)).otherwise(none))
    return (
        F.when(task.isin(*UNMASKED), policy(False, task, none, none))
        .when(description.isNotNull(), policy(True, F.lit("legacy_entity"), F.array(description), none))
        .when(task == "T4", objects).otherwise(policy(True, F.lit("legacy_target_phrase"), none, _listed(target)))
    )


def text_pair(task: Column, description: Column, anchor: Column, target: Column) -> Column:
    """What a text describes before and after an edit; both empty where it has no direction."""
    fixed = F.coalesce(*(F.when(task == t, F.lit(a)) for t, a in ANCHORS.items()))
    before = F.coalesce(fixed, description, F.when(task == "T4", F.nullif(anchor, F.lit(""))), F.lit(ANY_ANCHOR))
    blank = task.isin(*UNDIRECTED)
    return F.struct(F.when(blank, "").otherwise(before).alias("source_text"), F.when(blank, "").otherwise(F.coalesce(target, F.lit(""))).alias("target_text"))


def delta_max(task: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for t, d in DELTA_MAX.items() for x in (F.lit(t), F.lit(d)))), task)


def short_reference(description: Column) -> Column:
    """A short name for who is described: the subject, with what is worn or else a mark."""
    d = F.lower(description)
    subject, garment, mark = F.lit(ANYONE), F.lit(None).cast("string"), F.lit("")
    for word, name in reversed(SUBJECTS):
        found = F.contains(d, F.lit(word))
        subject = F.when(found & ~F.contains(d, F.lit("young woman")) if word == "girl" else found, F.lit(name)).otherwise(subject)
    for words in reversed(WORN):
        tail = F.split_part(F.split_part(F.substr(d, F.instr(d, words) + F.lit(len(words))), F.lit(","), F.lit(1)), F.lit(" and "), F.lit(1))
        garment = F.when(F.contains(d, F.lit(words)), F.concat(F.lit(" in the "), F.trim(F.regexp_replace(tail, r"\b(over|with|on)\b.*$", "")))).otherwise(garment)
    for word, text in reversed(MARKS):
        mark = F.when(F.contains(d, F.lit(word)), F.lit(text)).otherwise(mark)
    return F.concat(subject, F.coalesce(garment, mark))


def attribute_target(attribute: Column, value: Column) -> Column:
    """The phrase that describes a person with a changed attribute."""
    bare = F.trim(F.replace(value, F.lit(" hair"), F.lit("")))
    return (
        F.when(attribute == "hair color", F.concat(F.lit("a person with "), bare, F.lit(" hair")))
        .when(attribute.isin("jacket color", "shirt color", "glasses", "hat"), F.concat(F.lit("a person wearing "), value))
        .otherwise(F.concat(F.lit("a person with "), value, F.lit(" "), attribute))
    )


#: Wordings of instructions by task and kind, taken in turn. In braces stand names of what fills them: a_x is x with its article, Ref a reference with a capital.
INSTRUCTIONS = {
    ("T1", ""): (
        "Replace {ref} with {target}, in every shot they appear.",
        "Throughout the video, swap {ref} for {target}.",
        "Make {ref} into {target}; keep their actions and positions identical across all shots.",
        "Recast {ref} as {target} for the entire scene.",
    ),
    ("T2", "hair color"): (
        "Change {ref}'s hair color to {unhaired}, throughout the video.",
        "{Ref} now has {bare} hair, in every shot.",
        "Recolor {ref}'s hair to {bare} across all shots.",
    ),
    ("T2", "jacket color"): (
        "Re-dress {ref} in {value} instead, in every shot.",
        "Swap {ref}'s jacket for {value}, throughout the video.",
        "{Ref} now wears {value} for the entire video.",
    ),
    ("T2", "shirt color"): (
        "Change {ref}'s shirt to {value}, throughout the video.",
        "Dress {ref} in {value} for every shot.",
        "Replace {ref}'s shirt with {value} in all shots.",
    ),
    ("T2", "glasses"): (
        "Add {value} to {ref}, in every shot.",
        "{Ref} now wears {value}, throughout the video.",
        "Place {value} on {ref} for the entire scene.",
    ),
    ("T2", "hat"): (
        "Put {value} on {ref}, in every shot.",
        "{Ref} now wears {value}, throughout the video.",
        "Add {value} to {ref} across all shots.",
    ),
    ("T2", ""): ("Change {ref}'s {attribute} to {value}, throughout the video.",),
    ("T3", ""): (
        "Re-render the entire video in the visual style of {style}.",
        "Restyle every shot as {style}.",
        "Apply a {style} look to the whole video, preserving the action and shot order.",
        "Make the entire video read as {style}.",
    ),
    ("T4", "replace"): (
        "Replace the {old} with {new}, wherever it appears.",
        "Throughout the video, swap the {old} for {new}.",
        "Where the {old} would be, show {new} instead.",
    ),
    ("T4", "add"): (
        "Add {new} beside the {anchor}, in every shot the {anchor} is visible.",
        "Place {new} next to the {anchor}, throughout the video.",
        "Insert {new} alongside the {anchor} in all shots where it appears.",
    ),
    ("T4", "remove"): (
        "Remove the {old} from every shot.",
        "Erase the {old} entirely from the video.",
        "The {old} should not appear in any shot.",
    ),
    ("T4", ""): ("",),
    ("T5", ""): (
        "Reorder the video to shot order {order}.",
        "Change the shot sequence to {order}, preserving each shot's content.",
        "Make the edited video play in this shot order: {order}.",
    ),
    ("T6", ""): (
        "Re-shoot shot {shot} as {a_framing} with {a_camera}.",
        "Shot {shot} should be filmed as {a_framing}; apply {a_camera}.",
        "Re-frame shot {shot} as {a_framing} and add {a_camera}.",
        "Reshoot shot {shot} with {framing} framing and {a_camera}.",
    ),
    ("T7", ""): (
        "Replace every hard cut with {a_transition}.",
        "Use {transition} transitions instead of cuts between every shot.",
        "Connect the shots with {transition} transitions rather than hard cuts.",
        "Smooth the cuts into {transition} transitions throughout the video.",
    ),
}
#: What a phrase of an attribute begins with, ends of it that are attributes of one word, and the framing that is no "shot".
PERSON_WITH, PLAIN_ATTRIBUTES, CLOSE = "a person with ", ("glasses", "hat"), "extreme close-up"


def attribute_of(phrase: Column) -> Column:
    """struct<attribute, value> of "a person with <value> <attribute>": the last word, or the last two before "color"; else "attribute" and all of it."""
    rest = F.replace(phrase, F.lit(PERSON_WITH), F.lit(""))
    parts = F.split(rest, " ")
    last = F.element_at(parts, -1)
    head = lambda drop: F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - drop, F.lit(0))), " ")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), " ")
    made = lambda attribute, value: F.struct(attribute.alias("attribute"), value.alias("value"))
    several = F.size(parts) >= 2
    return F.when(several & (last == "color"), made(tail, head(2))).when(several & last.isin(*PLAIN_ATTRIBUTES), made(last, head(1))).otherwise(made(F.lit("attribute"), rest))


def wording(task: Column, kind: Column, turn: Column) -> Column:
    """The wording of a task whose turn it is among those of its kind, or of its kind "" if it has none of that name; null for other tasks. Looked up in a short list."""
    table = lambda rows: F.create_map(*(F.lit(x) for row in rows for x in row))
    sizes = table([(f"{t}|{k}", len(texts)) for (t, k), texts in INSTRUCTIONS.items()])
    every = table([(f"{t}|{k}|{i}", text) for (t, k), texts in INSTRUCTIONS.items() for i, text in enumerate(texts)])
    named, plain = F.concat(task, F.lit("|"), kind), F.concat(task, F.lit("|"))
    own = F.coalesce(F.when(F.try_element_at(sizes, named).isNotNull(), named), plain)
    return F.try_element_at(every, F.concat(own, F.lit("|"), F.pmod(turn, F.try_element_at(sizes, own)).cast("string")))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def rewritten(task: Column, turn: Column, ref: Column, parsed: Column, target: Column, extra: dict[str, Column]) -> tuple[Column, Column]:
    """(instruction, target phrase) of a prompt in new words; null where its task has no wordings. turn: the prompt's number in its task, from 0. ref and parsed:
    columns of short_reference() and attribute_of(), which are used often. extra: op, old_object, new_object, anchor, new_order (array),
    target_shot_id, target_framing, camera_move, transition_style; nulls are empty."""
    x = lambda name: F.coalesce(extra[name].cast("string"), F.lit(""))
    attribute, value = parsed["attribute"], parsed["value"]
    unhaired, style = F.replace(value, F.lit(" hair"), F.lit("")), F.replace(target, F.lit(" look"), F.lit(""))
    order = F.array_join(F.coalesce(extra["new_order"].cast("array<string>"), F.array().cast("array<string>")), ", ")
    framing, camera, transition = x("target_framing"), x("camera_move"), x("transition_style")
    names = {
        "ref": ref, "Ref": capitalised(ref), "target": target, "attribute": attribute, "value": value, "unhaired": unhaired, "bare": F.trim(unhaired), "style": style, "old": x("old_object"), "new": x("new_object"), "anchor": x("anchor"),
        "order": order, "shot": x("target_shot_id"), "framing": framing, "a_framing": article(framing), "a_camera": article(camera), "transition": transition, "a_transition": article(transition),
    }
    kind = F.when(task == "T2", attribute).when(task == "T4", x("op")).otherwise("")
    framed = F.when(F.endswith(framing, F.lit(" shot")) | (framing == CLOSE), article(framing)).otherwise(F.concat(article(framing), F.lit(" shot")))
    phrase = (
        F.when(task == "T1", target).when(task == "T2", attribute_target(attribute, value)).when(task == "T3", F.concat(F.lit("a "), style, F.lit(" look")))
        .when(task == "T4", F.when(x("op") == "remove", F.concat(F.lit("a scene without the "), x("old_object"))).otherwise(extra["new_object"]))
        .when(task == "T5", F.concat(F.lit("shots reordered to "), order)).when(task == "T6", framed).when(task == "T7", F.concat(article(transition), F.lit(" transition")))
    )
    return filled(wording(task, kind, turn), **names), phrase


def _json(value: Column) -> Column:
    """A text or number as JSON."""
    whole = F.to_json(F.array(value))
    return F.coalesce(F.when(value.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2)), F.lit("null"))


def _json_list(values: Column) -> Column:
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(values, _json), ", "), F.lit("]")), F.lit("null"))


#: What a message says of an edit's extras, in this order.
EXTRAS = ("op", "old_object", "new_object", "anchor", "transition_style", "target_framing", "camera_move", "new_order")


def payload(task: Column, instruction: Column, target: Column, extra: dict[str, Column], applicable: Column, lead: str = "Rewrite this:\n") -> Column:
    """A message of a lead and an edit as JSON, parted by ", " and ": ": nulls as null, extras (some of EXTRAS; new_order a list) only if they are there, and the list of shots that it applies to."""
    some = [F.when(extra[n].isNotNull(), F.concat(F.lit(f'"{n}": '), _json_list(extra[n]) if n == "new_order" else _json(extra[n]))) for n in EXTRAS if n in extra]
    inner = F.concat(F.lit("{"), F.concat_ws(", ", *some), F.lit("}"))
    fields = {"task_id": _json(task), "instruction": _json(instruction), "target_phrase": _json(target), "extra": inner, "applicable_shots": _json_list(applicable)}
    return F.concat(F.lit(lead + "{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{n}": '), v) for n, v in fields.items())), F.lit("}"))


def phrases(objects: Column, characters: Column) -> Column:
    """array<struct<phrase, kind, ref_id>>: a video's objects by their names, then its characters by their descriptions."""
    made = lambda phrase, kind, ref: F.struct(phrase.alias("phrase"), F.lit(kind).alias("kind"), ref.cast("string").alias("ref_id"))
    none = F.array().cast("array<struct<phrase:string,kind:string,ref_id:string>>")
    return F.concat(
        F.coalesce(F.transform(objects, lambda o: made(o, "object", o)), none), F.coalesce(F.transform(characters, lambda c: made(c["desc"], "character", c["id"])), none)
    )


def mask_queries(given: Column, task: Column, legacy: Column) -> Column:
    """A prompt's mask queries: as given (a struct; lists as texts or JSON lists), else by its legacy policy of mask_policy().

    Columns: nep_applicable, edit_scope, edit_type, source_queries, edited_queries, combine, reason.
    """
    names = ("nep_applicable", "edit_scope", "edit_type", "source_queries", "edited_queries", "combine", "reason")
    whole = task.isin(*UNMASKED)
    kept = [F.coalesce(given["nep_applicable"], F.lit(False)), given["edit_scope"], given["edit_type"], _queries(given["source_queries"]), _queries(given["edited_queries"]), F.coalesce(given["combine"], F.lit("union")), given["reason"]]
    by_task = [
        legacy["nep_applicable"], F.when(whole, "global_or_structural").otherwise("local"), legacy["edit_type"], legacy["source_queries"], legacy["edited_queries"],
        F.when(whole, "none").otherwise("union"), F.when(whole, F.concat(F.lit("task "), task, F.lit(" has no local edit-region mask policy"))),
    ]
    return F.when(given.isNotNull(), F.struct(*(c.alias(n) for n, c in zip(names, kept, strict=True)))).otherwise(F.struct(*(c.alias(n) for n, c in zip(names, by_task, strict=True))))


def _queries(value: Column) -> Column:
    return F.coalesce(listed(value), F.array().cast("array<string>"))
