"""Word lists and patterns whose values must be these for right results."""

# Words that carry no content in retrieval.
STOP_WORDS = (
    "a an the is are was were be been being this that these those what how why when where who whom which "
    "explain tell me about in on of to for and or does do did can could would should will shall may might must "
    "you your yours please it its with from by as at into onto than then so such not no nor but if else also "
    "i my we our they their them he she his her there here have has had having very just more most some any "
    "first second one two three use used using uses new like well many much make makes made "
    "each other all both few only own same too s t don now up down out over under again further once"
).split()

# Words that make poor key terms.
GENERIC_WORDS = (
    "system systems process method methods thing things way ways type types part parts example examples following used using result results data "
    "consists consist occurs occur refers refer reduces reduce uses use helps help address enables enable applies apply passes pass computes compute "
    "updates update explores explore evaluates evaluate learns provides provide makes make gives give takes take describes describe means mean "
    "includes include contains contain another called known study subset based allows allow shows show given found"
).split()

# Everyday words that make poor quiz answers even when they are frequent.
PLAIN_WORDS = (
    "before after event events software tool tools name names description category popular lightweight platform edition "
    "version following recommended problem problems code make sure please kindly various advanced first last "
    "remaining important simple basic general specific common different new old good best main key important "
    "page pages section chapter example figure table use user users time times day days way ways part parts "
    "development management framework environment application applications service services server integrated "
    "community edition standard support features feature information content details level"
).split()

# Endings of words that name things.
NOUN_ENDINGS = r"(tion|sion|ment|ness|ity|ance|ence|ism|ogy|ure|ics|ship|hood|ware|work|base|ist|er|or)$"

# What a sentence defines, and what does something in it.
DEFINED = (
    r"(?iu)^(?:(?:an?|the)\s+)?(.{3,50}?)\s+(?:is|are|refers to|means|is defined as|is called|is used to|are used to|stands for)\s+(.{12,})$"
)
DOING = (
    r"(?iu)^(?:(?:an?|the)\s+)?([\p{L}][\p{L}\p{N}*-]*(?:\s+[\p{L}\p{N}*-]+){0,2}?)\s+"
    r"(?:consists? of|occurs? when|uses?|explores?|evaluates?|computes?|enables?|helps?|combines?|discovers?|learns?|builds?|stores?|tracks?|converts?|displays?|contains?|provides?|allows?)(?![A-Za-z0-9_])"
)

# Lines of a résumé that measure something, what parts its lists of skills, and an address.
MEASURED = r"(?i)\d+(\.\d+)?\s*(%|x\b|\+|k\b|users|ms\b|hours|days|students|customers|clients)"
SKILL_SPLIT = r"\s*[,|•;·/]\s*|\s{2,}"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"

# What an answer names that a further question can be asked about.
FIGURE = r"(?i)[^.!?]*?\b\d[\d,.]*\s*(?:%|percent|x\b|ms\b|milliseconds|seconds?|minutes?|hours?|days?|weeks?|users?|students?|people|customers|requests|transactions|times)[^.!?]*"
CHALLENGE = r"(?i)\b(bug|issue|problem|challenge|outage|failure|error|deadline|bottleneck|crash|conflict|migration|delay)\b"
TEAM = r"(?i)\b(team|teammates?|manager|client|stakeholders?|colleagues?)\b"

# Technical names (internal capitals, digits, + or #).
TECHNICAL_SHAPE = r"^[.]?\p{L}[\w.+#-]*$"
TECHNICAL = r"[a-z][A-Z]|[A-Z]{2,}|\p{L}\d|\+\+|#|^\.[A-Z]|\.js$"

# Words that stay small inside a title.
SMALL_WORDS = "a an and as at by for from in into of on or the to with".split()

# Words of a question that say nothing about its subject.
QUESTION_NOISE = "tell describe explain walk through give time about your would what which how why when where situation example specific".split()

# Suffixes of the search stemmer, in the order in which they are tried.
SEARCH_SUFFIXES = (
    "izations", "isations", "ization", "isation", "ations", "ation", "ements", "ement", "ments", "ment", "ness",
    "ities", "ity", "ings", "ing", "izes", "ises", "ized", "ised", "ize", "ise", "ers", "er", "ies", "es", "ed", "ly",
    "al", "s",
)

# Roman numerals of unit numbers.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}

# Short forms that a search also reads in full.
SHORT_FORMS = {
    "dbms": "database management systems",
    "rdbms": "relational database management systems",
    "db": "database",
    "os": "operating systems",
    "cn": "computer networks",
    "dsa": "data structures algorithms",
    "ds": "data structures",
    "daa": "design analysis algorithms",
    "ada": "analysis design algorithms",
    "oop": "object oriented programming",
    "oops": "object oriented programming",
    "coa": "computer organization architecture",
    "co": "computer organization",
    "toc": "theory computation",
    "flat": "formal languages automata theory",
    "cd": "compiler design",
    "se": "software engineering",
    "ai": "artificial intelligence",
    "ml": "machine learning",
    "dl": "deep learning",
    "nlp": "natural language processing",
    "cv": "computer vision",
    "iot": "internet things",
    "dm": "discrete mathematics",
    "dwdm": "data warehousing data mining",
    "wt": "web technologies",
    "cc": "cloud computing",
    "is": "information security",
    "cns": "cryptography network security",
    "ppl": "principles programming languages",
    "pps": "programming problem solving",
    "stld": "switching theory logic design",
    "deld": "digital electronics logic design",
    "de": "digital electronics",
    "beee": "basic electrical electronics engineering",
    "evs": "environmental science",
    "eg": "engineering graphics",
    "la": "linear algebra",
    "ps": "probability statistics",
    "pns": "probability statistics",
    "m1": "mathematics 1",
    "m2": "mathematics 2",
    "m3": "mathematics 3",
    "pyq": "previous papers",
    "pyqs": "previous papers",
    "qp": "question paper",
    "imp": "important",
    "ques": "questions",
    "qns": "questions",
    "sem": "semester",
    "ppt": "slides",
    "lab": "lab practical",
    "sup": "supply",
}

# Skills recognised in any text, as patterns, longest match by list order.
SKILLS = (
    "JavaScript|TypeScript|Python|Java|C\\+\\+|C#|Go|Golang|Rust|Kotlin|Swift|PHP|Ruby|Scala|R|MATLAB|SQL|NoSQL|"
    "HTML|CSS|React|React Native|Next\\.js|Vue|Angular|Svelte|Node\\.js|Express|Django|Flask|FastAPI|Spring( Boot)?|"
    ".NET|Laravel|Flutter|Android|iOS|GraphQL|REST( APIs?)?|gRPC|MongoDB|PostgreSQL|MySQL|SQLite|Redis|Firebase|"
    "Supabase|DynamoDB|Elasticsearch|Kafka|RabbitMQ|AWS|Azure|GCP|Google Cloud|Docker|Kubernetes|Terraform|Jenkins|"
    "GitHub Actions|CI/CD|Git|Linux|Bash|Nginx|Microservices|System Design|Data Structures|Algorithms|OOP|"
    "Machine Learning|Deep Learning|NLP|Computer Vision|TensorFlow|PyTorch|Keras|scikit-learn|Pandas|NumPy|"
    "OpenCV|LLMs?|RAG|Hugging Face|Transformers|Data Analysis|Power BI|Tableau|Excel|Spark|Hadoop|Airflow|"
    "Figma|UI/UX|Agile|Scrum|Jira|Testing|Jest|Selenium|Cypress|Unit Testing|Blockchain|Solidity|Unity"
)

# Words whose casing a transcript keeps.
TRANSCRIPT_TERMS = (
    "API|APIs|SQL|NoSQL|AWS|GCP|UI|UX|CSS|HTML|JSON|REST|GraphQL|CI/CD|GPU|CPU|AI|ML|NLP|LLM|LLMs|SDK|URL|HTTP|HTTPS|"
    "JavaScript|TypeScript|Python|Java|React|Redux|Redis|Node.js|Next.js|Vue|Angular|Django|Flask|FastAPI|Docker|"
    "Kubernetes|GitHub|GitLab|Git|PostgreSQL|MySQL|MongoDB|Firebase|TensorFlow|PyTorch|Kafka|Linux|Figma|Jira|OAuth|DevOps"
).split("|")

# Signals of situation, action and result in a spoken answer, and fillers.
SITUATION = (
    r"(?i)\b(when|while|during|at (my|our)|in (my|our) (last|previous|final|first)|project|team|client|course|internship|company|college|school|"
    r"university|startup|job|shop|store|hackathon|classmates?|for (a|an|my|our) \w+)\b"
)
ACTION = (
    r"(?i)\bI\s+(?:\w+ly\s+)?(?!am\b|was\b|think\b|feel\b|guess\b|believe\b|hope\b|want\b|would\b|will\b)(?:[a-z]+ed|built|led|made|wrote|set up|ran|"
    r"chose|took|found|got|began|brought|drew|taught|did|thought through|put|broke|fixed|handled|coded|designed|used|added|split|cut|sent|met|spoke|lead)\b"
)
RESULT = (
    r"(?i)(\d+(\.\d+)?\s*(%|x\b|ms|seconds|minutes|hours|days|users|people|percent|students|customers))|\b(result(ed)?|reduced|increased|improved|saved|"
    r"delivered|launched|shipped|grew|cut|achieved|won|outcome|successful(ly)?|finished|completed|praised|approved|went live)\b"
)
FILLERS = r"(?i)\b(um+|uh+|like|basically|actually|you know|kind of|sort of|literally|so yeah)\b"
REVIEW_FILLERS = r"(?i)\b(um+|uh+|like|basically|actually|you know|kind of|sort of|literally)\b"

# Shapes of sentences that define, list, say a purpose or spell out an acronym.
SUBJECT = (
    r"(?i)^(?:(?:an?|the)\s+)?([\p{L}][\p{L}\p{N}*-]*(?:\s+[\p{L}\p{N}*-]+){0,3}?)\s+"
    r"(?:is|are|refers to|means|is defined as|consists of|occurs when|stands for)\b"
)
LIST = (
    r"(?i)^(?:(?:an?|the)\s+)?([\p{L}][\p{L}\p{N}*-]*(?:\s+[\p{L}\p{N}*-]+){0,3}?)\s+"
    r"(?:consists of|includes?|contains?|has|have|involves?|comprises?)\s+(.+)$"
)
PURPOSE = (
    r"(?i)^(?:(?:an?|the)\s+)?([\p{L}][\p{L}\p{N}*-]*(?:\s+[\p{L}\p{N}*-]+){0,4}?)\s+"
    r"(?:is used to|are used to|helps?|enables?|allows?|lets?|ensures?|reduces?|prevents?|improves?)\b"
)
CLAUSE = (
    r"(?i)^([\p{L}-]{3,}\s[\p{L}]{3,})\s+(?:is|are|uses?|explores?|evaluates?|discovers?|computes?|updates?|predicts?|stores?|consists?|makes?|"
    r"finds?|returns?|takes?|works?)\b"
)
SPELLED_OUT = r"\b([A-Z]{2,6})\s+stands for\s+([^.]+)"
WEAK_SUBJECT = r"(?i)^(do|does|did|not|don't|it|its|this|that|these|those|they|there|here|which|we|you|i|he|she|please|kindly|also)\b"

# Status, kind and type domains of the dashboards.
TICKET_STATUSES = ("open", "in_progress", "resolved", "closed")
FEEDBACK_KINDS = ("question", "notes", "summary", "answer", "chat", "interview")
QUIZ_MARKS = (2, 5, 8)


def ascii_bounds(pattern: str) -> str:
    """``\\b`` between ASCII words, which Java otherwise reads by Unicode."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


SITUATION, ACTION, RESULT, FILLERS, REVIEW_FILLERS, SUBJECT, LIST, PURPOSE, CLAUSE, SPELLED_OUT, WEAK_SUBJECT = map(
    ascii_bounds, (SITUATION, ACTION, RESULT, FILLERS, REVIEW_FILLERS, SUBJECT, LIST, PURPOSE, CLAUSE, SPELLED_OUT, WEAK_SUBJECT)
)
