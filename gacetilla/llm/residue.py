"""Template residue, filler, error pages and script notices in place of content.

Normalised lines are counted by source; lines that stand in many documents of a source are its boilerplate and are
subtracted, whatever they say: a footer that asks for scripts excludes no article. Only where hardly any content of its own
remains the document is judged by all its lines, since a source may serve its error page a thousand times. A document is excluded if
what is judged holds evidence:

- an unfilled placeholder anywhere in a line, unless the line quotes it;
- filler (runs of pseudo-Latin, of keyboard mashing, or a form's empty headings);
- a line that is nothing but an error message or a notice that scripts or a browser check are required. Sentences that
  report or quote such messages are longer than these, carry quotation marks or verbs, and do not match;
- a waiting or reloading notice, if hardly anything else remains.

Scale: one Arrow pass over the texts leaves eight bytes a line; lines are counted by map-side partial sums on (source,
line); only documents with evidence go on from there. The patterns are fixed.

Defined results: null, empty and blank texts are no cases; null sources form one source of their own; a document
delivered twice counts once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gacetilla.llm.text import fold, source_key, stable_hash, written

PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|[$#]\{[\w. |]{1,40}\}|\[\[[\w. |]{1,40}\]\]|@@[\w.]{1,40}@@|%%?[a-z_.]{3,40}%|__[a-z_.]{3,40}__"
    r"|\[(?:completar|insertar|insert|agregar|poner|rellenar|escribir|cargando)\b[^\]\n]{0,40}\]|<[\w. ]{2,40} aqu[ií]>|&lt;[\w. ]{2,40}&gt;|\[object object\]|\bundefined undefined\b|\bnull null\b|\bnan nan\b"
    r"|\bX{2,4}/X{2,4}/X{2,4}\b|(?<![\w{$#])\{\d\}|(?<![\w%])%[sd]\b|\btk tk\b|[%$]\([\w.]+\)s?|(?<![\w{$#%])\{(?!sic\})[a-z][\w.]{2,30}\}(?!\})",
    re.I,
)
_LATIN = frozenset("lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum sit ut et".split())
_MASHED = re.compile(r"\b(asdf|xxx+|qwerty?|aaa+|blah?|bla|test|texto|foo)(?:[ ,.]+\1){3,}\b")
_SAMPLE = re.compile(r"\b(?:bajada|titulo|texto|parrafo|epigrafe|nota|copete|volanta) (?:de (?:ejemplo|prueba|relleno)|simulad[oa])\b|\bborrar antes de publicar\b|\b(?:aca|aqui) va (?:el|la) (?:cuerpo|texto|titulo|bajada|foto|epigrafe)\b")
_FILLER = re.compile(r"(?:este es un |aqui va (?:el )?)?texto (?:de (?:relleno|prueba|ejemplo)|simulado)\b.{0,60}|contenido de prueba\b.{0,40}|aqui va (?:el|la) (?:texto|titulo|bajada|cuerpo|foto).{0,40}")
_FORM = frozenset(("titulo", "bajada", "cuerpo de la noticia", "epigrafe", "firma", "volanta", "copete", "cuerpo"))
_HOST = r"[a-z0-9-]+(?:\.[a-z0-9-]+)+"
_ERROR = re.compile(
    rf"(?:(?:http(?:/1\.[01])?|error|codigo|status)[ :]*)+[45]\d\d(?:[ :|-]+.{{0,50}})?|(?:40\d|41\d|50[0-4])|[45]\d\d ?[-:|] ?.{{3,50}}|(?:(?:error )?[45]\d\d[ :-]*)?(?:not found|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|internal server error|forbidden|bad request|too many requests)"
    rf"|the requested url\b.{{0,60}}|this page isn.?t working.{{0,40}}|(?:ups|oops|uy)\b.{{0,60}}|something went wrong.{{0,40}}|an? (?:unexpected )?error (?:has )?occurred.{{0,60}}|(?:404[ -]*)?page not found.{{0,40}}|this (?:page|site) can.?t be reached.{{0,40}}"
    rf"|(?:acceso denegado|access denied)(?:[.:-].{{0,40}})?|cuenta suspendida.{{0,40}}|(?:ha ocurrido|se produjo|ocurrio) un error.{{0,70}}|error al (?:conectar|establecer|cargar|procesar).{{0,70}}|(?:su|tu|la) sesion (?:ha expirado|expiro|caduco).{{0,50}}"
    rf"|(?:el|este) contenido (?:solicitado |que buscas )?(?:ya )?no (?:esta|se encuentra) disponible.{{0,40}}|no (?:pudimos|se pudo|podemos) encontrar (?:lo que buscabas|la pagina|el contenido).{{0,40}}|(?:la )?pagina (?:que (?:buscas|busca|buscabas|solicito) )?(?:no (?:existe|encontrada|disponible)|fue (?:movida|eliminada)).{{0,60}}"
    rf"|(?:[45]\d\d[ :-]+)?pagina no encontrada|sitio en (?:mantenimiento|construccion).{{0,60}}|(?:el servidor )?{_HOST} tardo demasiado en responder|(?:php )?(?:warning|fatal error|parse error|notice|exception)\b ?:.{{0,160}}|si el problema persiste.{{0,60}}|servicio no disponible.{{0,60}}|database error.{{0,80}}|connection (?:timed out|refused).{{0,60}}"
)
_SCRIPT = re.compile(
    rf".{{0,60}}\b(?:habilit[ea]r?|activ[ae]r?|enable|requires?|encend[ea]r?)\b (?:el |los |your )?(?:java ?script|scripts)\b.{{0,60}}|(?:su|tu) navegador (?:no (?:admite|soporta|es compatible)|tiene (?:los )?(?:java ?)?scripts? (?:desactivad|deshabilitad|bloquead)).{{0,60}}|this (?:site|app|page) requires (?:java)?scripts?.{{0,80}}"
    rf"|noscript\b.{{0,80}}|como activar (?:los scripts|java ?script).{{0,40}}|checking your browser.{{0,60}}|verific(?:ando|amos) que no (?:sos|eres|es) un robot.{{0,20}}|(?:por favor )?complet[ea]r? el captcha.{{0,40}}|ddos protection.{{0,40}}|{_HOST} necesita revisar la seguridad de la conexion|.{{0,20}}no soy un robot|(?:please )?verify (?:that )?you are (?:a )?human.{{0,40}}|just a moment|(?:please )?(?:turn on|enable) (?:your )?cookies\b.{{0,60}}|(?:por favor )?(?:habilit[ea]r?|activ[ae]r?) (?:las |sus |tus )?cookies\b.{{0,60}}|javascript (?:is )?(?:disabled|required|desactivado|requerido).{{0,40}}"
)
_WAITING = re.compile(r"(?:espere|aguarde|espera|aguarda) un momento.{0,20}|redirigiendo en .{0,20}|cargando.{0,12}|loading.{0,12}|recargar la pagina|intenta con el buscador.{0,40}|nginx(?:/[\d.]+)?|cloudflare|ray id.{0,40}|tal vez te interesen estas notas")
_EDGES = re.compile(r"^[\s•»▸*\-–—>·.…!¡|#]+|[\s»\-–—*.…!·|:]+$")

_DIGITS = re.compile(r"\d+")
_SPOKEN = re.compile(r"[^\W\d_]+")
STRONG, WEAK, FORM = 1, 2, 3


def _quoted(line: str, at: int) -> bool:
    """Whether the place lies within quotation marks of a sentence that goes on outside them."""
    before = line[:at]
    return bool(before.count('"') % 2 and '"' in line[at:] or before.count("“") > before.count("”") or before.count("«") > before.count("»"))


def _in_speech(line: str, start: int, end: int) -> bool:
    """Whether quoted words stand on both sides of a place within quotation marks: speech into which a template put it. What is quoted
    for its own sake begins or ends the quotation."""
    opened = max(line.rfind(q, 0, start) for q in '"“«')
    closed = min((k for q in '"”»' if (k := line.find(q, end)) >= 0), default=len(line))
    return len(_SPOKEN.findall(line[opened + 1 : start])) >= 2 and bool(_SPOKEN.search(line[end:closed]))


#: A line without any of these holds no placeholder; the same for filler below.
_HINT = re.compile(r"[\[{<%$#@]|__|&lt;|[Xx]/|tk tk|undefined|null null|nan nan", re.I)
_LATIN_HINTS, _MASH_HINTS = ("ipsum", "lorem", "amet", "commodo", "cillum"), ("asdf", "xxx", "qwert", "aaa", "bla", "test", "texto", "foo")
#: No script notice is without one of these.
_SCRIPT_HINTS = ("script", "robot", "captcha", "browser", "ddos", "seguridad", "human", "moment", "cookies")
_SENTENCE_ENDS = re.compile(r"[.!?…][)\]]* +| [|»·-] ")
_SAMPLE_HINTS = ("ejemplo", "prueba", "relleno", "simulad", "borrar antes", "va el", "va la")


def _sentence_evidence(f: str) -> bool:
    """Whether a sentence of a long line, outside quotation marks, is nothing but an error message or a script notice."""
    script = any(h in f for h in _SCRIPT_HINTS)
    at = 0
    for end in [*(m.end() for m in _SENTENCE_ENDS.finditer(f)), len(f)]:
        core = _EDGES.sub("", f[at:end])
        if core and len(core) <= 220 and not any(q in core for q in '"“«') and not _quoted(f, at) and (_ERROR.fullmatch(core) or script and _SCRIPT.fullmatch(core)):
            return True
        at = end
    return False


def line_evidence(line: str, folded: str | None = None) -> int:
    """STRONG, WEAK, FORM (one heading of an empty form) or 0."""
    if _HINT.search(line):
        for m in PLACEHOLDER.finditer(line):
            if not _quoted(line, m.start()) or _in_speech(line, *m.span()):
                return STRONG
    f = fold(line) if folded is None else folded
    if any(h in f for h in _LATIN_HINTS):
        run = 0
        for m in re.finditer(r"[a-z]+", f):
            run = run + 1 if m[0] in _LATIN else 0
            if run >= 6:
                return STRONG
    if any(h in f for h in _MASH_HINTS) and _MASHED.search(f):
        return STRONG
    if any(h in f for h in _SAMPLE_HINTS) and (m := _SAMPLE.search(f)) and not _quoted(f, m.start()):
        return STRONG
    if len(f) > 240:
        return STRONG if _sentence_evidence(f) else 0
    core = _EDGES.sub("", f)
    if not core or len(core) > 220 or '"' in core or "“" in core or "«" in core:
        return 0
    if core in ("lorem ipsum", "lorem ipsum dolor sit amet") or _FILLER.fullmatch(core) or _ERROR.fullmatch(core) or _SCRIPT.fullmatch(core):
        return STRONG
    return WEAK if _WAITING.fullmatch(core) else FORM if core in _FORM else 0


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sorts, sizes = [], [], []
        for text in batch.column("text").to_pylist():
            k, s, n = [], [], []
            text = text or ""
            for line, f in zip(text.split("\n"), fold(text).split("\n")):
                line = " ".join(line.split())
                if line:
                    f = " ".join(f.split())
                    k.append(stable_hash(_DIGITS.sub("0", _EDGES.sub("", f))) >> 1)
                    s.append(line_evidence(line, f))
                    n.append(line.count(" ") + 1)
            keys.append(k), sorts.append(s), sizes.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), pa.array(keys, pa.list_(pa.int64())), pa.array(sorts, pa.list_(pa.int8())), pa.array(sizes, pa.list_(pa.int32()))], names=["doc_id", "host", "keys", "sorts", "sizes"])


def find_residue(documents: DataFrame, least_documents: int = 4, least_share: float = 0.03, little: int = 60) -> DataFrame:
    """(doc_id) of the documents whose residual text holds evidence. documents: (doc_id, source, text)."""
    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(source_key(F.col("source")), F.lit("")).alias("host"), "text").where("text is not null")
    weighed = written(kept.mapInArrow(_weigh, "doc_id long, host string, keys array<long>, sorts array<byte>, sizes array<int>"), "residue-lines")
    totals = weighed.groupBy("host").agg(F.countDistinct("doc_id").alias("n"))
    single = weighed.select("host", F.explode(F.array_distinct("keys")).alias("key"))
    recurrent = single.groupBy("host", "key").agg(F.count("*").alias("k")).where(F.col("k") >= least_documents).join(totals, "host").where(F.col("k") >= least_share * F.col("n")).select("host", "key", F.lit(True).alias("recurrent"))
    suspects = weighed.where(F.exists("sorts", lambda s: s > 0))
    lines = suspects.select("doc_id", "host", F.explode(F.arrays_zip("keys", "sorts", "sizes")).alias("l")).select("doc_id", "host", F.col("l.keys").alias("key"), F.col("l.sorts").alias("sort"), F.col("l.sizes").alias("size"))
    own = F.col("recurrent").isNull()

    def evidence(where: Column, name: str) -> list[Column]:
        """Of the lines that ``where`` takes: a strong one, a weak one, how many headings of a form."""
        return [
            F.coalesce(F.bool_or((F.col("sort") == STRONG) & where), F.lit(False)).alias(f"strong_{name}"), F.coalesce(F.bool_or((F.col("sort") == WEAK) & where), F.lit(False)).alias(f"weak_{name}"),
            F.size(F.collect_set(F.when((F.col("sort") == FORM) & where, F.col("key")))).alias(f"form_{name}"),
        ]

    seen = lines.join(recurrent, ["host", "key"], "left").groupBy("doc_id").agg(*evidence(own, "own"), *evidence(F.lit(True), "all"), F.sum(F.when((F.col("sort") == 0) & own, F.col("size")).otherwise(0)).alias("rest"))
    bare = F.col("rest") < little
    residual = F.col("strong_own") | (F.col("form_own") >= 3)
    whole = F.col("strong_all") | F.col("weak_all") | (F.col("form_all") >= 3)
    return seen.where(residual | bare & whole).select("doc_id")
