"""Curated dimensions as small tables. Callers with another corpus pass DataFrames of the same shape instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Canonical books in canonical order, as name|testament|abbreviations.
BOOKS = """
Genesis|OT|Gen,Gn
Exodus|OT|Ex,Exod
Leviticus|OT|Lev,Lv
Numbers|OT|Num,Nm,Nb
Deuteronomy|OT|Deut,Dt
Joshua|OT|Josh,Jos
Judges|OT|Judg,Jdg,Jgs
Ruth|OT|Ruth,Ru
1 Samuel|OT|1 Sam,1 Sm,1Sam
2 Samuel|OT|2 Sam,2 Sm,2Sam
1 Kings|OT|1 Kings,1 Kgs,1 Kg
2 Kings|OT|2 Kings,2 Kgs,2 Kg
1 Chronicles|OT|1 Chron,1 Chr
2 Chronicles|OT|2 Chron,2 Chr
Ezra|OT|Ezra,Ezr
Nehemiah|OT|Neh,Ne
Tobit|OT|Tob,Tb
Judith|OT|Jdt,Jth
Esther|OT|Esth,Est
1 Maccabees|OT|1 Macc,1 Mac,1 Mc
2 Maccabees|OT|2 Macc,2 Mac,2 Mc
Job|OT|Job,Jb
Psalms|OT|Ps,Pss,Psalm
Proverbs|OT|Prov,Prv,Pr
Ecclesiastes|OT|Eccl,Eccles,Qoh
Song of Songs|OT|Song,Sg,Cant
Wisdom|OT|Wis,Ws
Sirach|OT|Sir,Ecclus
Isaiah|OT|Isa,Is
Jeremiah|OT|Jer,Jr
Lamentations|OT|Lam,Lm
Baruch|OT|Bar
Ezekiel|OT|Ezek,Ez
Daniel|OT|Dan,Dn
Hosea|OT|Hos,Ho
Joel|OT|Joel,Jl
Amos|OT|Amos,Am
Obadiah|OT|Obad,Ob
Jonah|OT|Jonah,Jon
Micah|OT|Mic,Mi
Nahum|OT|Nah,Na
Habakkuk|OT|Hab,Hb
Zephaniah|OT|Zeph,Zep
Haggai|OT|Hag,Hg
Zechariah|OT|Zech,Zec
Malachi|OT|Mal,Ml
Matthew|NT|Matt,Mt
Mark|NT|Mark,Mk,Mc
Luke|NT|Luke,Lk,Lc
John|NT|John,Jn
Acts|NT|Acts,Ac
Romans|NT|Rom,Rm
1 Corinthians|NT|1 Cor,1Cor
2 Corinthians|NT|2 Cor,2Cor
Galatians|NT|Gal,Ga
Ephesians|NT|Eph,Ephes
Philippians|NT|Phil,Php
Colossians|NT|Col,Cl
1 Thessalonians|NT|1 Thess,1 Thes,1 Th
2 Thessalonians|NT|2 Thess,2 Thes,2 Th
1 Timothy|NT|1 Tim,1 Tm
2 Timothy|NT|2 Tim,2 Tm
Titus|NT|Titus,Ti,Tit
Philemon|NT|Philem,Phlm,Phm
Hebrews|NT|Heb,Hebr
James|NT|Jas,Jm
1 Peter|NT|1 Pet,1 Pt,1 Pe
2 Peter|NT|2 Pet,2 Pt,2 Pe
1 John|NT|1 John,1 Jn
2 John|NT|2 John,2 Jn
3 John|NT|3 John,3 Jn
Jude|NT|Jude,Jud
Revelation|NT|Rev,Rv,Apoc
"""

# Document-type phrases in matching order, as phrase|type.
DOC_TYPES = """
Dogmatic Constitution|Dogmatic Constitution
Pastoral Constitution|Pastoral Constitution
Apostolic Constitution|Apostolic Constitution
Post-Synodal Apostolic Exhortation|Apostolic Exhortation
Apostolic Exhortation|Apostolic Exhortation
Apostolic Exaltation|Apostolic Exhortation
Aposotolic Exhortation|Apostolic Exhortation
Apostolic Letter|Apostolic Letter
Pastoral Letter|Pastoral Letter
Encyclical Letter|Encyclical
Encyclical Epistle|Encyclical
Encyc. Letter|Encyclical
Encyc.letter|Encyclical
Encyclical|Encyclical
Motu Proprio|Motu Proprio
Radio Message|Message
Message|Message
Homily|Homily
Address|Address
Declaration|Declaration
Decree|Decree
Constitution|Constitution
Bull|Bull
Catechism|Catechism
Letter|Letter
"""

# Works known by a part of their normalised title, in matching order, as pattern|title|author|type.
WORKS = """
summa theolog|Summa Theologiae|Saint Thomas Aquinas|Scholastic treatise
summa contra gentiles|Summa contra Gentiles|Saint Thomas Aquinas|Scholastic treatise
scriptum super sententiis|Scriptum super Sententiis|Saint Thomas Aquinas|Commentary
super boetium de trinitate|Super Boetium de Trinitate|Saint Thomas Aquinas|Commentary
contra impugnantes|Contra impugnantes Dei cultum et religionem|Saint Thomas Aquinas|Treatise
de regimine principum|De Regimine Principum|Saint Thomas Aquinas|Treatise
summa th|Summa Theologiae|Saint Thomas Aquinas|Scholastic treatise
de civitate dei|De Civitate Dei|Saint Augustine|Theological treatise
city of god|De Civitate Dei|Saint Augustine|Theological treatise
confession|Confessions|Saint Augustine|Spiritual autobiography
enarrationes in psalmos|Enarrationes in Psalmos|Saint Augustine|Scripture commentary
de doctrina christiana|De Doctrina Christiana|Saint Augustine|Theological treatise
in iohannis evangelium tractatus|In Iohannis Evangelium Tractatus|Saint Augustine|Scripture commentary
tract in ioannem|In Iohannis Evangelium Tractatus|Saint Augustine|Scripture commentary
tract in joannem|In Iohannis Evangelium Tractatus|Saint Augustine|Scripture commentary
adversus haereses|Adversus Haereses|Saint Irenaeus of Lyons|Theological treatise
homiliae in matthaeum|Homilies on the Gospel of Matthew|Saint John Chrysostom|Homilies
in io homil|Homilies on the Gospel of John|Saint John Chrysostom|Homilies
de lazaro|De Lazaro|Saint John Chrysostom|Homilies
regula pastoralis|Regula Pastoralis|Saint Gregory the Great|Pastoral treatise
moralia in job|Moralia in Job|Saint Gregory the Great|Scripture commentary
divinae institutiones|Divinae Institutiones|Lactantius|Apologetic treatise
in joh|Commentary on the Gospel of John|Origen|Scripture commentary
in num homil|Homilies on Numbers|Origen|Homilies
hexaemeron|Hexaemeron|Saint Basil the Great|Homilies
expositio evangelii secundum lucam|Expositio Evangelii secundum Lucam|Saint Ambrose|Scripture commentary
exameron|Exameron|Saint Ambrose|Homilies
in matthaeum|Homilies on the Gospel of Matthew|Saint John Chrysostom|Homilies
de hominis opificio|De Hominis Opificio|Saint Gregory of Nyssa|Theological treatise
apologeticum|Apologeticum|Tertullian|Apologetic treatise
admonitions|Admonitions|Saint Francis of Assisi|Spiritual writing
regula non bullata|Earlier Rule (Regula non bullata)|Saint Francis of Assisi|Religious rule
earlier rule|Earlier Rule (Regula non bullata)|Saint Francis of Assisi|Religious rule
major legend of saint francis|The Major Legend of Saint Francis|Saint Bonaventure|Hagiography
in ii sent|Commentary on the Sentences|Saint Bonaventure|Commentary
on the condition of|Rerum Novarum|Leo XIII|Encyclical
pastoral constitution on the church in|Gaudium et Spes|Second Vatican Ecumenical Council|Pastoral Constitution
dei verbum|Dei Verbum|Second Vatican Ecumenical Council|Dogmatic Constitution
familiaris consortio|Familiaris Consortio|John Paul II|Apostolic Exhortation
donum vitae|Donum Vitae|Congregation for the Doctrine of the Faith|Instruction
immortale dei|Immortale Dei|Leo XIII|Encyclical
catechism of the catholic church|Catechism of the Catholic Church|Catholic Church|Catechism
das ende der neuzeit|Das Ende der Neuzeit|Romano Guardini|Philosophical work
aeneid|Aeneid|Virgil|Epic poem
divine comedy|The Divine Comedy|Dante Alighieri|Epic poem
the demons|The Demons|Fyodor Dostoevsky|Novel
jenseits von gut und b|Jenseits von Gut und Böse|Friedrich Nietzsche|Philosophical work
"""

# Issuing bodies by URL slug, first entry in force wins, as slug|since (YYYYMMDD or empty)|name.
BODIES = """
cfaith|20220605|Dicastery for the Doctrine of the Faith
cfaith||Congregation for the Doctrine of the Faith
justpeace||Pontifical Council for Justice and Peace
migrants||Pontifical Council for the Pastoral Care of Migrants and Itinerant People
ii_vatican_council||Second Vatican Council
"""

# Pontiffs, as author key|ordinal|name|start|end|slug|encyclopedia slug.
PONTIFFS = """
leo xiv|267|Leo XIV|2025||leone-xiv|Pope_Leo_XIV
francis|266|Francis|2013|2025|francesco|Pope_Francis
benedict xvi|265|Benedict XVI|2005|2013|benedetto-xvi|Pope_Benedict_XVI
john paul ii|264|Saint John Paul II|1978|2005|giovanni-paolo-ii|Pope_John_Paul_II
john paul i|263|John Paul I|1978|1978|giovanni-paolo-i|Pope_John_Paul_I
paul vi|262|Saint Paul VI|1963|1978|paolo-vi|Pope_Paul_VI
john xxiii|261|Saint John XXIII|1958|1963|giovanni-xxiii|Pope_John_XXIII
pius xii|260|Venerable Pius XII|1939|1958|pio-xii|Pope_Pius_XII
pius xi|259|Pius XI|1922|1939|pio-xi|Pope_Pius_XI
benedict xv|258|Benedict XV|1914|1922|benedetto-xv|Pope_Benedict_XV
pius x|257|Saint Pius X|1903|1914|pio-x|Pope_Pius_X
leo xiii|256|Leo XIII|1878|1903|leone-xiii|Pope_Leo_XIII
pius ix|255|Blessed Pius IX|1846|1878||Pope_Pius_IX
gregory the great|64|Saint Gregory the Great|590|604|gregorio-i--magno|Pope_Gregory_I
gregory i|64|Saint Gregory the Great|590|604|gregorio-i--magno|Pope_Gregory_I
leo the great|45|Saint Leo the Great|440|461|leone-i--magno|Pope_Leo_I
leo i|45|Saint Leo the Great|440|461|leone-i--magno|Pope_Leo_I
"""

# The profile page of a pontiff outside the usual folder, and the two URL patterns.
PONTIFF_URL_OVERRIDES = {"pius ix": "https://www.vatican.va/content/pius-ix/en.html"}
PONTIFF_URL = "https://www.vatican.va/content/vatican/en/holy-father/{}.html"
ENCYCLOPEDIA_URL = "https://en.wikipedia.org/wiki/{}"

# Spans of time, as author key|kind|start|end|label.
SPANS = """
council of trent|council|1545|1563|Council of Trent
first vatican ecumenical council|council|1869|1870|First Vatican Council
second vatican ecumenical council|council|1962|1965|Second Vatican Council
justin martyr|life|100|165|Saint Justin Martyr
irenaeus of lyons|life|130|202|Saint Irenaeus of Lyons
irenaeus|life|130|202|Saint Irenaeus of Lyons
clement of alexandria|life|150|215|Saint Clement of Alexandria
tertullian|life|155|220|Tertullian
origen|life|185|253|Origen
cyprian|life|210|258|Saint Cyprian
athanasius|life|296|373|Saint Athanasius
hilary of poitiers|life|310|367|Saint Hilary of Poitiers
basil the great|life|330|379|Saint Basil the Great
gregory of nazianzus|life|329|390|Saint Gregory of Nazianzus
gregory of nyssa|life|335|395|Saint Gregory of Nyssa
ambrose|life|339|397|Saint Ambrose
john chrysostom|life|347|407|Saint John Chrysostom
jerome|life|342|420|Saint Jerome
augustine|life|354|430|Saint Augustine
cyril of alexandria|life|376|444|Saint Cyril of Alexandria
maximus the confessor|life|580|662|Saint Maximus the Confessor
john damascene|life|675|749|Saint John Damascene
anselm|life|1033|1109|Saint Anselm
bernard of clairvaux|life|1090|1153|Saint Bernard of Clairvaux
anthony of padua|life|1195|1231|Saint Anthony of Padua
bonaventure|life|1221|1274|Saint Bonaventure
thomas aquinas|life|1225|1274|Saint Thomas Aquinas
catherine of siena|life|1347|1380|Saint Catherine of Siena
teresa of avila|life|1515|1582|Saint Teresa of Ávila
john of the cross|life|1542|1591|Saint John of the Cross
robert bellarmine|life|1542|1621|Saint Robert Bellarmine
francis de sales|life|1567|1622|Saint Francis de Sales
margaret mary alacoque|life|1647|1690|Saint Margaret Mary Alacoque
alphonsus liguori|life|1696|1787|Saint Alphonsus Liguori
john henry newman|life|1801|1890|Saint John Henry Newman
charles de foucauld|life|1858|1916|Saint Charles de Foucauld
therese of lisieux|life|1873|1897|Saint Thérèse of Lisieux
romano guardini|life|1885|1968|Romano Guardini
edith stein|life|1891|1942|Saint Teresa Benedicta (Edith Stein)
"""

# Other author keys of the same spans, as variant|key.
SPAN_ALIASES = """
second vatican council|second vatican ecumenical council
vatican council ii|second vatican ecumenical council
vatican ii|second vatican ecumenical council
first vatican council|first vatican ecumenical council
vatican council i|first vatican ecumenical council
trent|council of trent
"""

# The honorifics that a person's key drops, in order, and the particles that stay lower-case in a name.
HONORIFICS = ["his holiness", "pope", "saint", "st.", "st", "blessed", "bl.", "servant of god", "venerable"]
PARTICLES = "de del della dei di da du des von van der den la le les el y of for and the in on à".split()

# Pope slugs whose English name differs; path kinds of the second layer; language suffixes of a file name.
POPE_SLUGS = {"francesco": "Francis", "benedict-xvi": "Benedict XVI"}
LAYER2_KINDS = ["encyclicals", "apost_exhortations", "apost_letters"]
LANGUAGES = "en|sp|it|la|fr|ge|po|pt|de"

# The default seed pages.
SEED_BASE = "https://www.vatican.va/content/"
SEEDS = """
leo-xiv/en/encyclicals/documents/20260515-magnifica-humanitas.html
francesco/en/encyclicals/documents/papa-francesco_20201003_enciclica-fratelli-tutti.html
benedict-xvi/en/encyclicals/documents/hf_ben-xvi_enc_20051225_deus-caritas-est.html
benedict-xvi/en/encyclicals/documents/hf_ben-xvi_enc_20090629_caritas-in-veritate.html
francesco/en/encyclicals/documents/papa-francesco_20150524_enciclica-laudato-si.html
francesco/en/encyclicals/documents/20241024-enciclica-dilexit-nos.html
leo-xiii/en/encyclicals/documents/hf_l-xiii_enc_15051891_rerum-novarum.html
pius-xi/en/encyclicals/documents/hf_p-xi_enc_19310515_quadragesimo-anno.html
john-xxiii/en/encyclicals/documents/hf_j-xxiii_enc_15051961_mater.html
john-xxiii/en/encyclicals/documents/hf_j-xxiii_enc_11041963_pacem.html
paul-vi/en/encyclicals/documents/hf_p-vi_enc_26031967_populorum.html
john-paul-ii/en/encyclicals/documents/hf_jp-ii_enc_14091981_laborem-exercens.html
john-paul-ii/en/encyclicals/documents/hf_jp-ii_enc_30121987_sollicitudo-rei-socialis.html
john-paul-ii/en/encyclicals/documents/hf_jp-ii_enc_01051991_centesimus-annus.html
john-paul-ii/en/encyclicals/documents/hf_jp-ii_enc_06081993_veritatis-splendor.html
john-paul-ii/en/encyclicals/documents/hf_jp-ii_enc_25031995_evangelium-vitae.html
"""


def records(text: str) -> list[list[str]]:
    """The lines of a table above, cut at bars."""
    return [line.split("|") for line in text.strip().split("\n")]


def doc_types() -> list[tuple[str, str, bool]]:
    """(phrase, type, whether case counts) in matching order."""
    return [(p, t, not (" " in p or "." in p or p == "Encyclical")) for p, t in records(DOC_TYPES)]


def abbreviations() -> list[tuple[str, str, str, int]]:
    """(token, book, testament, ord) of every name and abbreviation; of a token of two books, the later book."""
    found: dict[str, tuple[str, str, int]] = {}
    for i, (name, testament, short) in enumerate(records(BOOKS)):
        for token in [name, *short.split(",")]:
            found[token] = (name, testament, i)
    return [(k, *v) for k, v in found.items()]


def seed_urls() -> list[str]:
    return [SEED_BASE + line for (line,) in records(SEEDS)]


def books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(abbreviations(), "token string, book string, testament string, ord int")


def works(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(records(WORKS))], "rank int, pattern string, work_title string, work_author string, work_type string")


def bodies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, d or None, n) for i, (s, d, n) in enumerate(records(BODIES))], "rank int, slug string, since string, body string")


def pontiffs(spark: SparkSession) -> DataFrame:
    rows = []
    for i, (key, n, name, start, end, slug, page) in enumerate(records(PONTIFFS)):
        url = PONTIFF_URL_OVERRIDES.get(key) or (PONTIFF_URL.format(slug) if slug else None)
        rows.append((i, key, int(n), name, int(start), int(end) if end else None, slug or None, url, ENCYCLOPEDIA_URL.format(page)))
    return spark.createDataFrame(rows, "rank int, author_key string, ordinal int, display_name string, reign_start int, reign_end int, slug string, profile_url string, encyclopedia_url string")


def spans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, kind, int(a), int(b), label) for k, kind, a, b, label in records(SPANS)], "span_key string, kind string, start int, end int, label string")


def span_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(records(SPAN_ALIASES), "variant string, span_key string")


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(seed_urls())), "doc_ord int, url string")
