"""Texts that the tests of this folder share."""

PASSAGE = (
    "Anblewh sttible athawh thonre was is anly hend and oftionnten. Enti a wherer anhe ntedin thhe the heon to of nd he reou. "
    "Athinti atsh inwhtion thoninti of and erst thentien anonly onorresh erth. Inat erorea eror that shth ortint on that shingen anines. "
    "Thinwh tiouwh of the tint inwh edblere to this thenwhre onwhingin ththesst to thontion inedat edouea aneses."
)
FILLER = "Some other words stand here before it, number {0} of them. And one more line follows with {0} in it."


def edge_rows():
    long_text = " ".join(f"wort{i % 977} the{i % 13}" for i in range(40_000))
    return [
        (1, f"{FILLER.format(1)} {PASSAGE}", "src0", "en"),
        (2, f"{FILLER.format(2)} {PASSAGE} Nothing else is left to say.", "src0", "en"),
        (2, f"{FILLER.format(2)} {PASSAGE} Nothing else is left to say.", "src0", "en"),
        (2, "The same id with quite another text.", "src1", None),
        (3, None, None, "en"),
        (4, "", "src1", "de"),
        (5, " \t\n ", "src1", "de"),
        (None, f"{PASSAGE}", "src0", "en"),
        (None, None, None, None),
        (6, long_text, "src0", "fr"),
        (7, "Über Straße, ça va? 中文 字 \x85 　x \x1c y  z\r\n\r\n don't I'LL 12345", "src2", "fr"),
        (8, "A a A a A a A a A a A a A a A a", "src2", "fr"),
        (9, "idiot", "src2", "es"),
    ]


CLASHING = ["_id", "_tie", "_text", "_w", "_url", "_site", "_block", "_cut", "_spans", "_bad_id", "_key", "_judged", "_deal", "_of_id", "fp", "head", "n_words", "kept", "toxic", "severity", "shard", "slot", "rule", "host", "n_removed_words", "component_id"]
