"""Writing systems of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import TRANSFER_SPECIALS, WORD_MARK

# Unicode script names, the most used first.
SCRIPTS = [
    "Latin", "Common", "Inherited", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Syriac", "Thaana",
    "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala",
    "Thai", "Lao", "Tibetan", "Myanmar", "Georgian", "Hangul", "Ethiopic", "Cherokee", "Khmer", "Mongolian",
    "Hiragana", "Katakana", "Bopomofo", "Han", "Yi",
    "Adlam", "Ahom", "Anatolian_Hieroglyphs", "Avestan", "Balinese", "Bamum", "Bassa_Vah", "Batak", "Bhaiksuki", "Brahmi",
    "Braille", "Buginese", "Buhid", "Canadian_Aboriginal", "Carian", "Caucasian_Albanian", "Chakma", "Cham", "Chorasmian",
    "Coptic", "Cuneiform", "Cypriot", "Deseret", "Dives_Akuru", "Dogra", "Duployan", "Egyptian_Hieroglyphs", "Elbasan",
    "Elymaic", "Glagolitic", "Gothic", "Grantha", "Gunjala_Gondi", "Hanifi_Rohingya", "Hanunoo", "Hatran", "Imperial_Aramaic",
    "Inscriptional_Pahlavi", "Inscriptional_Parthian", "Javanese", "Kaithi", "Kayah_Li", "Kharoshthi", "Khitan_Small_Script",
    "Khojki", "Khudawadi", "Lepcha", "Limbu", "Linear_A", "Linear_B", "Lisu", "Lycian", "Lydian", "Mahajani", "Makasar",
    "Mandaic", "Manichaean", "Marchen", "Masaram_Gondi", "Medefaidrin", "Meetei_Mayek", "Mende_Kikakui", "Meroitic_Cursive",
    "Meroitic_Hieroglyphs", "Miao", "Modi", "Mro", "Multani", "Nabataean", "Nandinagari", "New_Tai_Lue", "Newa", "Nko", "Nushu",
    "Nyiakeng_Puachue_Hmong", "Ogham", "Ol_Chiki", "Old_Hungarian", "Old_Italic", "Old_North_Arabian", "Old_Permic",
    "Old_Persian", "Old_Sogdian", "Old_South_Arabian", "Old_Turkic", "Osage", "Osmanya", "Pahawh_Hmong", "Palmyrene",
    "Pau_Cin_Hau", "Phags_Pa", "Phoenician", "Psalter_Pahlavi", "Rejang", "Runic", "Samaritan", "Saurashtra", "Sharada",
    "Shavian", "Siddham", "SignWriting", "Sogdian", "Sora_Sompeng", "Soyombo", "Sundanese", "Syloti_Nagri", "Tagalog",
    "Tagbanwa", "Tai_Le", "Tai_Tham", "Tai_Viet", "Takri", "Tangut", "Tifinagh", "Tirhuta", "Ugaritic", "Vai", "Wancho",
    "Warang_Citi", "Yezidi", "Zanabazar_Square",
]


def script_of(char: Column) -> Column:
    """Script of one character by its Unicode property, UNK where it has none."""
    found = F.when(char.rlike(r"^\p{IsLatin}"), "Latin")
    for name in SCRIPTS[1:]:
        found = found.when(char.rlike(rf"^\p{{Is{name}}}"), name)
    return found.otherwise("UNK")


def script_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """Code points and scripts from table lines ``A..B ; Script # note`` or ``A ; Script``."""
    body = F.trim(F.regexp_replace(column, "#.*$", ""))
    parts = F.split(body, r"\s*;\s*")
    ends = F.split(F.get(parts, F.lit(0)), r"\.\.")
    low = F.conv(F.get(ends, F.lit(0)), 16, 10).cast("int")
    high = F.coalesce(F.conv(F.get(ends, F.lit(1)), 16, 10).cast("int"), low)
    kept = lines.where((body != "") & body.contains(";"))
    return kept.select(F.explode(F.sequence(low, high)).alias("code"), F.get(parts, F.lit(1)).alias("script"))


def _bare(token: Column) -> Column:
    """The token without one leading word mark, unless that is all it has."""
    marked = token.startswith(WORD_MARK) & (F.length(token) > 1)
    return F.when(marked, F.substr(token, F.lit(2))).otherwise(token)


def character_scripts(chars: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Script of each distinct character (char, script): by its property, or by a table of code points, UNK where there is none.

    There are at most 1,114,112 characters, however many rows hold them.
    """
    distinct = chars.select("char").distinct()
    if table is None:
        return distinct.select("char", script_of(F.col("char")).alias("script"))
    # code point of a character: its big-endian UTF-32 bytes
    code = F.conv(F.hex(F.encode(F.col("char"), "UTF-32")), 16, 10).cast("int")
    looked = distinct.withColumn("code", code).join(table, "code", "left")
    return looked.select("char", F.coalesce("script", F.lit("UNK")).alias("script"))


def token_script(tokens: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Most frequent script of a token's characters, the first seen on a tie; UNK for tokens without characters.

    Scripts are looked up once for each distinct character, from its Unicode property or from a table of code points.
    """
    distinct = tokens.select("token").distinct()
    chars = distinct.select("token", F.posexplode(F.split(_bare(F.col("token")), "")).alias("pos", "char")).where(F.col("char") != "")
    known = F.broadcast(character_scripts(chars, table))  # one row per code point at most
    counts = chars.join(known, "char").groupBy("token", "script").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    main = counts.groupBy("token").agg(F.max_by("script", F.struct("n", -F.col("first"))).alias("script"))
    return tokens.select("token", "id").join(main, "token", "left").select("token", "id", F.coalesce("script", F.lit("UNK")).alias("script"))


def script_groups(scripts: DataFrame, specials: list[str] = TRANSFER_SPECIALS, word_position: bool = True) -> DataFrame:
    """Category of each token: its script, with the position in the word. Special tokens are also in a category of their own."""
    place = F.when(F.col("token").startswith(WORD_MARK), "_initial").otherwise("_medial")
    category = F.concat("script", place) if word_position else F.col("script")
    named = scripts.select("token", "id", category.alias("category"))
    own = scripts.where(F.col("token").isin(specials)).select("token", "id", F.lit("special").alias("category"))
    return named.unionByName(own)
