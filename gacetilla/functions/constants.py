"""Fixed values that results depend on, kept as plain lists in their natural order."""

# Words without weight in headlines.
STOPWORDS = [
    "el", "la", "los", "las", "de", "del", "en", "un", "una", "y", "a", "que", "se", "con", "por", "es", "su", "al", "lo", "le", "esta", "este",
    "son", "ha", "fue", "para", "como", "más", "no", "ya", "sin", "ante", "sobre", "pero", "sus", "muy", "ser", "hasta", "hay", "entre", "cómo",
    "cuándo", "qué", "cuál", "cuáles", "quién", "quiénes", "dónde", "también", "así", "aún", "según", "desde", "todo", "toda", "todos", "todas",
    "otro", "otra", "otros", "otras",
]

# Words without weight in page titles and image queries.
SHORT_STOPWORDS = [
    "el", "la", "los", "las", "de", "del", "en", "un", "una", "y", "a", "que", "se", "con", "por", "es", "su", "al", "lo", "le", "esta", "este",
    "son", "ha", "fue",
]

# Place words too common to tell events apart.
LOW_SIGNAL = ["necochea", "quequén", "quequen", "mar", "plata", "argentina", "buenos", "aires", "provincia", "nacional", "país", "region", "región", "san"]

# Places that count as entities wherever they stand in a headline.
PLACES = ["necochea", "quequén", "quequen", "lobería", "loberia", "san cayetano", "miramar", "tres arroyos", "claromecó", "ruta 88", "ruta 11", "ruta 3"]

# Parts of addresses that are no articles.
NOT_ARTICLES = [
    "/video/", "/category/", "/tag/", "/author/", "/wp-content/", "/feed/", "/page/", "#", "/publicidad/", "/aviso/", "/contacto/", "/quienes-somos/",
    "/politicas-de-privacidad/", "/seccion/", "/categoria/", "/edicion-impresa", "/cdn-cgi/", "/ultimas-noticias/",
]

# Section by the first of these that a free-entered name contains, in this order.
SECTION_OF = [
    ("policiales", "Policiales"), ("policial", "Policiales"), ("seguridad", "Policiales"), ("judiciales", "Policiales"), ("accidentes", "Policiales"),
    ("economia", "Economía"), ("economía", "Economía"), ("economic", "Economía"), ("campo", "Economía"), ("agro", "Economía"), ("agropecuaria", "Economía"),
    ("empresas", "Economía"), ("negocios", "Economía"), ("rural", "Economía"), ("industria", "Economía"),
    ("política", "Política"), ("politica", "Política"), ("politics", "Política"), ("nacionales", "Política"), ("nación", "Política"), ("argentina", "Política"),
    ("mundo", "Política"), ("elecciones", "Política"), ("gobierno", "Política"),
    ("deportes", "Deportes"), ("deporte", "Deportes"), ("sports", "Deportes"), ("futbol", "Deportes"), ("básquet", "Deportes"),
    ("sociedad", "Sociedad"), ("social", "Sociedad"), ("generales", "Sociedad"), ("medio ambiente", "Sociedad"), ("ambiente", "Sociedad"),
    ("espectaculos", "Sociedad"), ("espectáculos", "Sociedad"), ("tendencias", "Sociedad"), ("mujer", "Sociedad"),
    ("local", "Local"), ("ciudad", "Local"), ("la ciudad", "Local"), ("necochea", "Local"), ("locales", "Local"), ("zonales", "Local"), ("zona", "Local"),
    ("servicios", "Local"), ("tránsito", "Local"), ("turismo", "Local"), ("quequén", "Local"), ("quequen", "Local"), ("san cayetano", "Local"),
    ("lobería", "Local"), ("loberia", "Local"), ("general", "Local"),
    ("salud", "Salud"), ("health", "Salud"), ("educacion", "Educación"), ("educación", "Educación"), ("universidad", "Educación"),
    ("cultura", "Cultura"), ("culture", "Cultura"), ("arte", "Cultura"), ("música", "Cultura"), ("musica", "Cultura"),
    ("tecnologia", "Tecnología"), ("tecnología", "Tecnología"), ("obituarios", "Obituarios"), ("fúnebres", "Obituarios"), ("sepelios", "Obituarios"),
    ("farmacias", "Farmacias"), ("turno", "Farmacias"), ("clima", "Clima"), ("pronóstico", "Clima"),
]

# Sections that may tell of the same event.
SECTION_GROUPS = [["Deportes"], ["Policiales"], ["Política", "Local"], ["Economía"], ["Sociedad", "Salud", "Cultura"]]

# Month names.
MONTHS = [
    ("enero", 1), ("febrero", 2), ("marzo", 3), ("abril", 4), ("mayo", 5), ("junio", 6), ("julio", 7), ("agosto", 8), ("septiembre", 9), ("setiembre", 9),
    ("octubre", 10), ("noviembre", 11), ("diciembre", 12),
]

# Fields that a rewritten note must have.
REQUIRED_FIELDS = ["titulo", "cuerpo", "resumen_seo", "instagram_text", "instagram_titulo", "twitter_text", "guion_video", "slug", "seccion_sugerida"]

# Texts at which a page of notices ends.
NOTICE_ENDS = ["Más avisos fúnebres", "Noticias relacionadas", "Seguinos en redes", "BRANDSAFETY"]

# Dates in free text, 'D/M/Y' with any dash or slash and 'D de MES [de] YYYY'.
NUMERIC_DATE = r"\b(\d{1,2})\s*[/\-–—]\s*(\d{1,2})\s*[/\-–—]\s*(\d{2,4})\b"
WRITTEN_DATE = r"(?i)\b(\d{1,2})\s+de\s+([a-záéíóúñ]+)(?:\s+de)?\s+(\d{4})\b"

# Texts of the prompts for one note and for the versions of several sources.
PROMPT_SECTION = "Sección: "
PROMPT_TITLE = "Título original: "
PROMPT_SOURCE = "Fuente original (para atribución opcional, no la copies textualmente): "
PROMPT_BODY = "Cuerpo original:"
PROMPT_REFERENCE = "Título referencial: "
PROMPT_COUNT = "Cantidad de fuentes: "
PROMPT_SOURCES = "Medios de origen (para atribución opcional, no los copies textualmente): "
PROMPT_VERSIONS = ("A continuación las ", " versiones del mismo hecho:")
VERSION = ("[Versión ", "]:")
NEXT_VERSION = "--- VERSIÓN SIGUIENTE ---"

# Parts of a page that are not its text.
DROPPED = ["script", "style", "noscript", "header", "footer", "aside", "nav", ".sharedaddy", ".jp-relatedposts", ".tags-links", ".post-navigation", ".wp-block-buttons"]

# Where the text of an article stands when the site has no selectors of its own.
CONTENT = ["article", ".single-content", ".entry-content", ".post-content", ".content-body"]

# Where the pictures of an article stand when the site has no selectors of its own.
PICTURE_CONTENT = ["article", ".entry-content", ".post-content"]

# Descriptions and pictures in a page's head, and attributes that hold a picture's address.
DESCRIPTIONS = ['meta[property="og:description"]', 'meta[name="description"]', 'meta[name="twitter:description"]']
HEAD_PICTURES = ['meta[property="og:image"]', 'meta[name="twitter:image"]', 'meta[property="og:image:secure_url"]']
CARD_PICTURES = ["src", "data-src", "data-lazy-src", "data-original"]

# The section line of a message.
MESSAGE_SECTION = "📂 Sección: "
