"""Letters of one shape in the Latin, Greek and Cyrillic scripts.

Chosen from Unicode's data of confusable characters: two letters of one case (Lu with Lu, Ll with Ll) without marks of their own that
have one skeleton there, and one shape. A test reads that data from the engine's own library; it holds that every pair below stands
in it, and that every group of everyday letters in it is either below or named as left out. Left out are letters that are only alike,
with another stem, hook or height: α γ ι κ ρ σ υ ω, г к м н в т п ф and the small capitals of their shape, ı, ſ, ß with β, є with ε.
"""

# Letters and the letter whose shape they have.
SAME_SHAPE = {
    "CYRILLIC": {
        "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "У": "Y", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G",
        "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
        "Г": "Γ", "П": "Π", "Ф": "Φ", "Ѱ": "Ψ", "ѱ": "ψ", "Л": "Λ", "Ә": "Ə", "ә": "ə", "Ө": "Ɵ", "ө": "ɵ", "Ӕ": "Æ", "ӕ": "æ", "Ԑ": "Ɛ", "Ӡ": "Ʒ", "ӡ": "ʒ", "Ꙅ": "Ƨ", "ꙅ": "ƨ",
    },
    "GREEK": {
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϝ": "F", "Ϻ": "M", "Ͻ": "Ɔ", "Ͷ": "И",
        "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "ν": "v", "ͻ": "ɔ",
    },
    "LATIN": {"ɡ": "g", "ɑ": "a", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "Đ": "Ð", "Ɖ": "Ð", "ǝ": "ə", "Ʌ": "Λ", "Ʃ": "Σ"},
}
