"""The code rules that ship with the library. All expressions, words, distances and confidences below are fixed values."""

from __future__ import annotations

from siftkite.operators.rules import Gate, LineRule, Near, TextRule, any_of

# Where a value comes from outside.
REQUEST = [r"request\.[a-zA-Z_]+", r"req\.[a-zA-Z_]+", r"params\[", r"args\[", r"form\[", r"json\[", r"input\s*\("]
PROCESS = [r"sys\.argv", r"os\.environ", r"\b\w+_[iI]nput\b", r"\buser_[a-zA-Z_]+\b"]
SQL_INPUT = REQUEST + PROCESS
COMMAND_INPUT = SQL_INPUT + [r"\bcmd\b", r"\bcommand\b"]
HTML_INPUT = REQUEST + [r"user_[a-zA-Z_]+", r"\w+_[iI]nput\b"]
REQUEST_PARTS = [r"request\.[a-zA-Z_]+", r"request\.args", r"request\.json", r"request\.form", r"request\.data"]
PROMPT_INPUT = REQUEST_PARTS + [r"params\[", r"args\[", r"form\[", r"json\[", r"input\s*\(", *PROCESS, r"body\[", r"headers\[", r"query\["]
OBJECT_INPUT = REQUEST_PARTS + [r"request\.values", r"params\[", r"args\[", r"form\[", r"json\[", r"body\[", r"query\[", r"sys\.argv", r"os\.environ", r"\b\w+_[iI]d\b", r"\buser_[a-zA-Z_]+\b", r"\bid\b", r"\buid\b"]

# Calls of models, their outputs, and what is done with these.
MODEL_CALLS = [
    r"openai\.[a-zA-Z_]+\.create", r"openai\.ChatCompletion\.create", r"openai\.Completion\.create", r"openai\.chat\.completions\.create", r"anthropic\.messages\.create", r"anthropic\.completions\.create",
    r"google\.generativeai\.generate_content", r"google\.ai\.generativelanguage\.v1beta2\.Service\.generate_content", r"cohere\.generate", r"cohere\.chat", r"aws\.bedrock\.invoke_model", r"bedrock\.invoke_model",
    r"llm\.generate", r"llm\.chat", r"chat\.send_message", r"model\.generate", r"model\.chat", r"Completion\.create", r"ChatCompletion\.create",
]
SCHEMA_CALLS = [
    r"openai\.(ChatCompletion|Completion)\.create", r"OpenAI\(.*\)\.chat\.completions\.create", r"openai\.create_chat_completion", r"client\.chat\.completions\.create", r"anthropic\.messages\.create",
    r"model\.invoke", r"llm\.invoke", r"chat\.send_message", r"chat\.create", r"completion\.create", r"generate_content",
]
MODEL_OUTPUT = [r"response\.text", r"response\.content", r"output\.text", r"message\.content", r"completion\.text", r"result\.text", r"llm\.response", r"model\.output", r"chat_completion", r"create_completion", r"generate\("]
SINKS = [
    r"execute\s*\(", r"exec\s*\(", r"eval\s*\(", r"system\s*\(", r"os\.system", r"os\.popen", r"subprocess", r"cursor\.execute", r"db\.execute", r"conn\.execute", r"\.query\s*\(", r"raw\s*\(", r"sql\s*=",
    r"open\s*\(", r"file\s*\(", r"__import__", r"compile\s*\(", r"child_process\.exec", r"child_process\.spawn", r"new\s+Function", r"setTimeout", r"setInterval",
]
VALIDATION = [r"validate\s*\(", r"sanitize\s*\(", r"escape\s*\(", r"check\s*\(", r"verify\s*\(", r"schema\.validate", r"jsonschema\.validate", r"pydantic", r"marshmallow", r"ajv\.validate", r"zod\.parse"]
SCHEMAS = [r"response_format\s*=", r"response_schema\s*=", r"schema\s*=", r"json_schema\s*=", r"output_schema\s*=", r"structure\s*=", r"response\.format", r"StructuredOutput", r"JsonSchema", r"output_parser", r"pydantic", r"function_call\s*=", r"tools\s*="]
DISPLAY = [
    r"print\s*\(", r"console\.log", r"document\.write", r"innerHTML\s*=", r"outerHTML\s*=", r"render\s*\(", r"display\s*\(", r"show\s*\(", r"return\s+", r"res\.send", r"res\.json", r"render_template",
    r"Response\.json", r"send_message", r"send_text", r"reply\s*\(", r"post\s*\(", r"message\.reply", r"\.text\s*=",
]
SAFETY = [
    r"moderation", r"content.*(filter|classification|check)", r"safety.*(check|filter|classify)", r"filter.*(content|harmful|toxic)", r"classify.*(content|text)", r"is_safe", r"is_valid", r"check_(harmful|toxic|unsafe)",
    r"safe_(check|validate)", r"harmful.*(content|detect)", r"toxicity", r"profanity", r"nsfw", r"content.*(policy|guideline)", r"OpenAI\.Moderation", r"AzureContentSafety", r"TextAnalyticsClient", r"comprehend.*(toxicity|moderation)",
]
CLAIMS = [
    r"according to\s+\w+", r"it is (a )?fact that", r"it is (well )?known that", r"the (latest |current )?\w+ (data|information|study|research) shows", r"studies (show|indicate|suggest)", r"research (shows|indicates|suggests)",
    r"data (shows|indicates|suggests)", r"statistics show", r"this is (a )?common (fact|belief|understanding)", r"as (stated|mentioned|noted) in\s+\w+", r"the (official|authoritative|verified) (source|report|data)",
    r"confirmed (by|that)", r"(definitely|certainly|obviously|clearly) (is|are|was|were)", r"always (is|are|was|were)", r"never (is|are|was|were)", r"it is (impossible|guaranteed|certain) that", r"is (guaranteed|certain|definite) to",
]
GROUNDING = [
    r"retrieve?\s*\(", r"search\s*\(", r"query\s*\(", r"vector.*search", r"similarity.*search", r"embedding.*search", r"knowledge.*base", r"rag", r"retrieval.*augmented", r"grounding", r"citation",
    r"reference\s*\(", r"sources\s*=", r"context\s*=", r"document.*search", r"database.*query", r"fetch.*knowledge", r"retrieve.*context",
]
HEDGES = [
    r"i am not sure", r"i don'?t know", r"i cannot (verify|confirm|guarantee)", r"uncertain", r"may vary", r"it depends", r"not (certain|sure)", r"might (be|have)", r"could be", r"possibly", r"probably", r"typically",
    r"usually", r"in general", r"on average", r"according to (our|this|the) (database|knowledge base)", r"based on (the |our )?(provided |given )?(context|data|information)",
]

LINE_RULES = [
    LineRule("unvalidated_output", (any_of(*MODEL_OUTPUT), any_of(*SINKS)), "critical", 0.85, none_of=any_of(*VALIDATION)),
    LineRule("schema_missing", (any_of(*SCHEMA_CALLS),), "medium", 0.75, around=any_of(*SCHEMAS), lines=(4, 5)),
    LineRule("hallucination_risk", (any_of(*CLAIMS),), "medium", 0.7, none_of=any_of(*HEDGES), unless=any_of(*GROUNDING)),
    LineRule("safety_filter_missing", (any_of(*MODEL_OUTPUT), any_of(*DISPLAY)), "medium", 0.75, unless=any_of(*SAFETY)),
]


def _with(inputs: list[str], patterns: list[str], flags: str = "i") -> tuple[str, ...]:
    """Expressions whose <in> stands for any of the inputs."""
    return tuple(any_of(p.replace("<in>", "|".join(inputs)), flags=flags) for p in patterns)


# The expressions of the rules over whole texts. <in> is any of a rule's inputs.
SQL = [
    r"(?:cursor|db|conn|connection)\.execute\s*\(\s*f[\"'][^\"']*\{[^}]*(?:<in>)[^}]*\}[^\"']*[\"']",
    r"(?:cursor|db|conn|connection)\.execute\s*\(\s*[\"'][^\"']*(?:<in>)[^\"']*[\"']\s*\+",
    r"(?:cursor|db|conn|connection)?\.?execute\s*\(\s*[\"'][^\"']*%[sdfe][^\"']*[\"']\s*%\s*(?:<in>)",
    r"(?:cursor|db|conn|connection)?\.?execute\s*\(\s*[\"'][^\"']*\{[^}]*\}[^\"']*[\"']\s*\.format\s*\(\s*(?:<in>)",
    r"\.raw\s*\(\s*(?:f[\"']|.*\+|.*\.format).*(?:<in>)",
]
SQL_BOUND = [
    r"execute\s*\(\s*[\"'][^\"']*%s[^\"']*[\"']\s*,\s*\(?\s*\w+",
    r"execute\s*\(\s*[\"'][^\"']*\?[^\"']*[\"']\s*,\s*\(?\s*\w+",
    r"execute\s*\(\s*[\"'][^\"']*\$\d+[^\"']*[\"']\s*,\s*\(?\s*\w+",
    r"execute\s*\(\s*[\"'][^\"']*:[a-zA-Z_]+[^\"']*[\"']\s*,\s*\{?\s*[\"']?:[a-zA-Z_]+",
]
SQL_BOUND_LINE = [r",\s*\(\s*\w+", r",\s*\[\s*\w+", r",\s*\w+\s*\)", r"execute\s*\(\s*\w+\s*,\s*\w+"]
SAMPLE_VALUES = [r"['\"]test['\"]", r"['\"]example['\"]", r"['\"]demo['\"]", r"['\"]sample['\"]"]
COMMAND = [
    r"os\.system\s*\(\s*(?:f[\"']|.*\+\s*)(?:<in>)",
    r"os\.popen\s*\(\s*(?:f[\"']|.*\+\s*)(?:<in>)",
    r"subprocess\.(?:call|run|Popen)\s*\([^)]*shell\s*=\s*True[^)]*(?:<in>)",
    r"subprocess\.(?:call|run|Popen)\s*\(\s*(?:f[\"']|.*\+\s*)(?:<in>)",
    r"eval\s*\(\s*(?:<in>)",
    r"exec\s*\(\s*(?:<in>)",
]
COMMAND_LISTS = [r"subprocess\.(?:call|run|Popen)\s*\(\s*\[", r"subprocess\.(?:call|run|Popen)\s*\(\s*args\s*=\s*\["]
COMMAND_CONSTANT = [r"['\"].*['\"]\s*\+\s*['\"].*['\"]", r"f['\"][^'{]*['\"]"]
COMMAND_QUOTED = [r"shlex\.quote", r"pipes\.quote", r"re\.escape", r"validate", r"sanitize", r"escape"]
HTML = [
    r"innerHTML\s*=\s*(?:.*\+\s*)?(?:<in>)",
    r"document\.write\s*\(\s*(?:.*\+\s*)?(?:<in>)",
    r"\.html\s*\(\s*(?:.*\+\s*)?(?:<in>)",
    r"render_template_string\s*\(\s*(?:f[\"'].*\{|.*\+\s*)(?:<in>)",
    r"mark_safe\s*\(\s*(?:<in>)",
    r"\{\s*\{\s*(?:<in>)[^}]*\|\s*safe",
    r"return\s+(?:<in>)",
    r"(?:Response|HttpResponse|make_response)\s*\(\s*(?:<in>)",
]
HTML_SAFE = [r"escape\s*\(", r"html\.escape", r"bleach\.clean", r"sanitize", r"\.text\s*\(", r"textContent\s*=", r"autoescape\s+true"]
HTML_CONSTANT = [r"['\"]<\w+", r"['\"].*</\w+>['\"]"]
FRAMEWORKS = [r"import\s+React", r"from\s+['\"]react['\"]", r"import\s+Vue", r"from\s+['\"]vue['\"]", r"import\s+\{\s*Component\s*\}", r"@Component"]
KEYS = [
    r"SECRET_KEY\s*=\s*[\"'][^\"']{8,}[\"']",
    r"JWT_SECRET\s*=\s*[\"'][^\"']{8,}[\"']",
    r"JWT_KEY\s*=\s*[\"'][^\"']{8,}[\"']",
    r"AES_KEY\s*=\s*[\"'][^\"']{16,}[\"']",
    r"ENCRYPTION_KEY\s*=\s*[\"'][^\"']{8,}[\"']",
    r"SIGNING_KEY\s*=\s*[\"'][^\"']{8,}[\"']",
    r"PRIVATE_KEY\s*=\s*[\"']-----BEGIN",
    r"key\s*=\s*[\"'][a-zA-Z0-9]{16,}[\"']",
]
KEYS_OUTSIDE = [r"SECRET_KEY\s*=\s*os\.environ", r"SECRET_KEY\s*=\s*os\.getenv", r"SECRET_KEY\s*=\s*[\"']\$\{"]
MASKED_KEYS = ["SECRET_KEY", "JWT_SECRET", "AES_KEY", "ENCRYPTION_KEY"]
CIPHERS = [
    r"hashlib\.md5\s*\(", r"MD5\s*\(", r"hashlib\.sha1\s*\(", r"SHA1\s*\(", r"from\s+Crypto\.Cipher\s+import\s+DES", r"DES\.new\s*\(", r"DES3\.new\s*\(",
    r"Random\.random\s*\(\s*\)", r"math\.random\s*\(\s*\)", r"random\.random\s*\(\s*\)", r"random\.randint\s*\(", r"random\.choice\s*\(",
]
ECB = [r"AES\.new\s*\([^)]*,\s*AES\.MODE_ECB", r"MODE_ECB"]
CIPHER_LEVELS = [(r"password|passwd|pwd|secret|key", "critical"), (r"token|auth|session|jwt", "critical"), (r"encrypt|decrypt|sign|verify|hash", "high")]
RANDOM = [r"random\.random\s*\(\s*\)", r"random\.randint\s*\(", r"random\.choice\s*\(", r"random\.randrange\s*\(", r"Math\.random\s*\(\s*\)", r"Math\.floor\s*\(\s*Math\.random", r"new\s+Random\s*\(", r"Random\.Next\s*\("]
RANDOM_SECRET = r"password|passwd|pwd|secret|token|key|auth|session|csrf|nonce|salt|iv"
RANDOM_SAFE = [r"secrets\.", r"crypto\.random", r"secrets\.token_hex", r"secrets\.randbelow", r"SystemRandom"]
EXPOSED = [
    r"log(?:ger)?\.(?:debug|info|warning|error|critical)\s*\([^)]*password",
    r"log(?:ger)?\.(?:debug|info|warning|error|critical)\s*\([^)]*token",
    r"log(?:ger)?\.(?:debug|info|warning|error|critical)\s*\([^)]*secret",
    r"log(?:ger)?\.(?:debug|info|warning|error|critical)\s*\([^)]*credit",
    r"print\s*\([^)]*password", r"print\s*\([^)]*token", r"console\.log\s*\([^)]*password", r"console\.log\s*\([^)]*token",
    r"return\s+.*password", r"return\s+.*token", r"json\.dumps\s*\([^)]*password", r"response\[.*password", r"res\.json\s*\([^)]*password", r"res\.send\s*\([^)]*password",
    r"raise\s+Exception\s*\([^)]*password", r"raise\s+.*Error\s*\([^)]*password", r"flash\s*\([^)]*password",
    r"ssn\s*=\s*[\"']\d{3}-\d{2}-\d{4}[\"']", r"credit_card\s*=\s*[\"']\d{16}[\"']", r"email\s*=\s*[\"'][^\"']+@[^\"']+\.[^\"']+[\"']", r"phone\s*=\s*[\"']\d{10,}[\"']",
]
EXPOSED_MASKS = [("password", "****"), ("token", "****"), ("secret", "****"), ("ssn", "***-**-****"), ("credit_card", "*" * 16)]
CONFUSABLE = ["[\u0410-\u042f][\u0430-\u044f]+", "[\u0391-\u03a9][\u03b1-\u03c9]+", "[a-zA-Z][\u0430-\u044f\u0410-\u042f]+", "[\u0430-\u044f\u0410-\u042f][a-zA-Z]+"]
IMITATED = ["admin", "login", "password", "signin", "account", "user", "root", "administrator", "system"]
STRING_STEPS = [r"==\s*[\"']", r"!=\s*[\"']", r"\.replace\s*\(", r"\.split\s*\(", r"\.lower\s*\(", r"\.upper\s*\(", r"\.strip\s*\(", r"hash\s*\(", r"in\s+[\"']", r"[\"']\s+in\s+", r"assert\s+", r"if\s+"]
COMPARED = [r"(?:<in>)\s*(?:f?[\"'][^\"']*[\"']|input\(|sys\.argv|\w+\[)", r"(?:password|passwd|pwd|secret|token|auth)\s*(?:==|!=|\b(?:in|not in)\b)\s*"]
NORMALIZED = [r"unicodedata\.normalize\s*\(\s*['\"]NFC['\"]", r"unicodedata\.normalize\s*\(\s*['\"]NFKC['\"]", r"normalize\s*\(\s*['\"]NFC['\"]", r"normalize\s*\(\s*['\"]NFKC['\"]"]
BIDI_ESCAPES = [r"\\u202[ABCDE]", r"\\u206[6789]", r"\\x202[ABCDE]", r"\\x206[6789]"]
BIDI = "[\u202a-\u202e\u2066-\u2069]"
BIDI_PLACES = ["file", "path", "url", "uri", "link", "filename", "dir", "folder", "ext", "extension"]
PROMPTS = [
    r"(?:prompt\s*[:=]\s*(?:f?[\"'][^\"']*(?:<in>)[^\"']*[\"']|<in>))",
    r"(?:system\s*[:=]\s*(?:f?[\"'][^\"']*\{[^}]*(?:<in>)[^}]*\}[^\"']*[\"']|<in>))",
]
PROMPTS_OVER_LINES = [
    r"(?:system\s*[:=]\s*[\"']?(?:.*?)?[\"']?\s*\+?\s*(?:f?[\"'][^\"']*(?:<in>)[^\"']*[\"']|<in>))",
    r"(?:messages\s*=\s*\[.*?\{[^}]*(?:content\s*[:=]\s*(?:f?[\"'][^\"']*(?:<in>)[^\"']*[\"']|<in>)))",
]
OVERRIDES = [
    r"ignore\s+(?:all\s+)?previous\s+(?:instructions?|commands?|orders?)",
    r"disregard\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions?)",
    r"(?:forget|ignore)\s+(?:everything|all)\s+(?:you|I've|I)\s+(?:were|told|learned|said)",
    r"ignore\s+(?:your\s+)?(?:programming|constraints|guidelines)",
    r"new\s+instructions?:",
    r"(?:you\s+)?(?:are now|will now|should now)\s+(?:act as|be|follow)\s+[^.]{10,}",
    r"(?:for the purpose of|to)\s+(?:this|that)\s+(?:challenge|test|experiment)",
    r"(?:bypass|break|circumvent)\s+(?:your|these|the)\s+(?:safety|security|content)",
    r"(?:roleplay|pretend)\s+as\s+(?:a\s+)?(?:different|new|unrestricted)",
    r"\\boxed\{", r"\\[a-z]+\{[^}]+\}", r"<(?:script|style|iframe)[^>]*>", r"<\?xml[^>]*>", r"\[\[INST\]\][^\]]+\[\[/INST\]\]", r"<<SYS>>[^<]*<</SYS>>", r"<\|system\|>", r"<\|user\|>",
    r"#{3,}\s*(?:system|user|assistant)", r"---{3,}", r"END{2,}", r"={3,}", r"\^\\^", "░" * 10, "█" * 10, "▓" * 10,
]
LENGTH_CHECKS = [r"len\s*\(", r"max_length", r"truncate", r"slice\s*\(", r"\[:\s*\d+\]", r"\.split\s*\(\s*[\"'][^\"']*[\"']\s*,\s*\d+", r"if\s+len\(", r"assert\s+len\("]
OBJECT_READS = [
    r"\.get\s*\(", r"\.find\s*\(", r"\.filter\s*\(", r"\.query\s*\(", r"\.fetch\s*\(", r"\.select\s*\(", r"cursor\.execute", r"db\.find", r"db\.findOne", r"Model\.findById", r"Model\.findOne", r"collection\.find",
    r"collection\.findOne", r"table\.select", r"session\.get", r"cache\.get",
]
AUTHORIZATION = [
    r"is_authenticated", r"check_permission", r"verify_access", r"authorize", r"has_permission", r"check_ownership", r"verify_ownership", r"validate_access", r"can_access", r"check_authorization", r"@login_required",
    r"@require_auth", r"@authenticated", r"if\s+user\.id\s*==", r"if\s+user_id\s*==", r"if\s+request\.user",
]
BUSINESS = [
    r"(?:price|amount|quantity|discount|coupon|rate|fee)\s*=\s*(?:request\.[a-zA-Z_]+|params\[|args\[|form\[|json\[|[a-zA-Z_]+)",
    r"if\s*\(\s*[a-zA-Z_]+\s*[<>]=\s*0\s*\)\s*\{?\s*return",
    r"timestamp\s*[<>]=\s*(?:time\.time\(\)|datetime\.now\(\))",
]
BUSINESS_OVER_LINES = [r"(?:discount|coupon|reward|points)\s*\.\s*apply(?:(?!\.validate|\.check)[^;])*request"]
# A check, and a use within 500 characters after it.
RACES = [
    (r"(?:if|while|assert)\s*\([^)]*file_exists|os\.path\.exists|is_file|is_dir|exists|stat|get_status", r"(?:open|read|write|execute|chmod|chown|delete|remove|unlink)\s*\("),
    (r"(?:if|while|assert)\s*\([^)]*lock|acquire|semaphore|mutex", r"(?:unlock|release|exit|return)\s*\("),
    (r"(?:balance|stock|quantity|count|available)\s*[<>]=", r"(?:balance|stock|quantity|count|available)\s*[+\-]="),
]
EVENTS = [
    r"login\s*\(", r"logout\s*\(", r"sign_in\s*\(", r"sign_out\s*\(", r"authenticate\s*\(", r"change_password\s*\(", r"reset_password\s*\(", r"update_password\s*\(", r"change_email\s*\(", r"update_email\s*\(",
    r"change_phone\s*\(", r"update_phone\s*\(", r"delete_account\s*\(", r"remove_account\s*\(", r"activate_account\s*\(", r"deactivate_account\s*\(", r"lock_account\s*\(", r"unlock_account\s*\(",
    r"grant_permission\s*\(", r"revoke_permission\s*\(", r"add_role\s*\(", r"remove_role\s*\(", r"make_admin\s*\(", r"remove_admin\s*\(", r"session\.create", r"session\.destroy", r"session\.invalidate", r"token\.create",
    r"token\.revoke",
]
LOG_CALLS = [
    r"log\.", r"logger\.", r"logging\.", r"audit", r"event\.log", r"security_log", r"log_event", r"record_event", r"write_log", r"log_handler", r"FileHandler", r"SysLogHandler", r"logging\.info", r"logging\.warning",
    r"logging\.error", r"logging\.critical",
]
BARE_LOGS = [
    r"log\.(?:info|warning|error|debug)\s*\(\s*[\"'][^\"']*[\"']\s*\)",
    r"logger\.(?:info|warning|error|debug)\s*\(\s*[\"'][^\"']*[\"']\s*(?:,\s*\{[^}]*\})?\s*\)",
]
AUDIT_FIELDS = [
    r"timestamp", r"datetime", r"time\.time\(\)", r"date", r"user[_\[]i?[d]", r"user_id", r"username", r"ip", r"ip_address", r"request\.remote_addr", r"request\.ip", r"session[_\[]i?[d]", r"session_id", r"action",
    r"operation", r"event", r"result", r"status",
]
SECRETS = [
    r"password", r"passwd", r"pwd", r"secret", r"api[_\s]?key", r"apikey", r"api_secret", r"access[_\s]?token", r"refresh[_\s]?token", r"auth[_\s]?token", r"bearer", r"authorization", r"credential", r"private[_\s]?key",
    r"social[_\s]?security", r"ssn", r"credit[_\s]?card", r"card[_\s]?number", r"cvv", r"pin", r"bank[_\s]?account", r"account[_\s]?number", r"routing[_\s]?number", r"tax[_\s]?id", r"passport", r"driver[_\s]?license",
    r"jwt", r"session[_\s]?key",
]
LOGGED = [r"(?:log\.|logger\.|logging\.|print\s*\(|console\.log|syslog|audit|event\.log)[a-z]*\s*\([^)]*(?:<in>)[^)]*\)", r"(?:log|logger|logging)\.(?:info|warn|error|debug|info|warning)\s*\(\s*f?[\"'][^\"']*(?:<in>)[^\"']*[\"']"]

_XSS_GATES = (
    Gate(line=any_of(*HTML_SAFE)),
    Gate(line=any_of(*HTML_CONSTANT, flags=""), lacks=any_of(*HTML_INPUT)),
    Gate(lacks=r"mark_safe|\|safe", text=(r"\{% extends|\{% block",)),
    Gate(lacks=r"\|safe", text=(r"\{% extends|\{\{ ", "autoescape")),
    Gate(text=(any_of(*FRAMEWORKS, flags=""),)),
)
_CIPHER = dict(levels=tuple((any_of(p), s) for p, s in CIPHER_LEVELS), lines=(4, 5))
_PROMPT = Near(any_of(*MODEL_CALLS), 500, 500, wanted=True, of_start=True)

#: Bidirectional controls written as escapes hit anywhere, the characters themselves on lines about files and links.
TEXT_RULES = [
    TextRule("sql_injection", _with(SQL_INPUT, SQL), "critical", 0.85, unless=(any_of(*SQL_BOUND),), gates=(Gate(line=any_of(*SQL_BOUND_LINE)), Gate(line=any_of(*SAMPLE_VALUES), lacks=any_of(*SQL_INPUT)))),
    TextRule("command_injection", _with(COMMAND_INPUT, COMMAND), "critical", 0.9, gates=(Gate(line=any_of(*COMMAND_LISTS)), Gate(line=any_of(*COMMAND_CONSTANT, flags=""), lacks=any_of(*COMMAND_INPUT)), Gate(line=any_of(*COMMAND_QUOTED)))),
    TextRule("xss", _with(HTML_INPUT, HTML), "high", 0.8, gates=_XSS_GATES, softer=(any_of(*HTML_SAFE), 0.6)),
    TextRule("hardcoded_key", tuple(map(any_of, KEYS)), "critical", 0.9, gates=(Gate(line=any_of(*KEYS_OUTSIDE)),), masks=tuple((rf"(?i)({k}\s*=\s*[\"'])[^\"']+([\"'])", r"\1****\2") for k in MASKED_KEYS)),
    TextRule("weak_crypto", tuple(map(any_of, CIPHERS)), "medium", 0.85, **_CIPHER),
    TextRule("weak_crypto", tuple(map(any_of, ECB)), "high", 0.85, **_CIPHER),
    TextRule("insecure_random", tuple(RANDOM), "medium", 0.75, levels=((any_of(RANDOM_SECRET), "high"), (any_of(*RANDOM_SAFE, flags=""), "info")), lines=(9, 5)),
    TextRule("sensitive_data", tuple(map(any_of, EXPOSED)), "high", 0.8, masks=tuple((rf"(?i)({k}\s*=\s*[\"'])[^\"']+([\"'])", rf"\g<1>{m}\2") for k, m in EXPOSED_MASKS)),
    TextRule("homoglyph", tuple(CONFUSABLE), "high", 0.75, word=any_of(*IMITATED)),
    TextRule("unnormalized_comparison", _with(STRING_STEPS, COMPARED, flags=""), "medium", 0.65, unless=(any_of(*NORMALIZED, flags=""),)),
    TextRule("bidi_control", tuple(BIDI_ESCAPES), "medium", 0.85),
    TextRule("bidi_control", (BIDI,), "medium", 0.9, on_line=any_of(*BIDI_PLACES)),
    TextRule("prompt_injection", _with(PROMPT_INPUT, PROMPTS) + _with(PROMPT_INPUT, PROMPTS_OVER_LINES, flags="is"), "high", 0.85, near=_PROMPT),
    TextRule("instruction_override", tuple(any_of(p, flags="im") for p in OVERRIDES), "high", 0.9),
    TextRule("context_overflow", _with(PROMPT_INPUT, [rf"(?:{'|'.join(MODEL_CALLS)})\s*\((?:[^)]*(?:<in>)[^)]*)?\)"]), "medium", 0.75, near=Near(any_of(*LENGTH_CHECKS), 800, 800)),
    TextRule("idor", _with(OBJECT_INPUT, [rf"(?:<in>)(?:\s*,\s*<in>)*\s*(?:=>|:|\))\s*(?:{'|'.join(OBJECT_READS)})"]), "high", 0.8, near=Near(any_of(*AUTHORIZATION), 500, 500)),
    TextRule("business_logic", tuple(map(any_of, BUSINESS)) + tuple(any_of(p, flags="is") for p in BUSINESS_OVER_LINES), "medium", 0.75),
    *[TextRule("race_condition", (any_of(check),), "medium", 0.7, near=Near(any_of(use), None, 500, wanted=True)) for check, use in RACES],
    TextRule("unlogged_event", tuple(map(any_of, EVENTS)), "medium", 0.85, near=Near(any_of(*LOG_CALLS), 300, 300)),
    TextRule("audit_trail", tuple(map(any_of, BARE_LOGS)), "medium", 0.75, unless=tuple(map(any_of, AUDIT_FIELDS)), enough=3),
    TextRule("sensitive_logs", _with(SECRETS, LOGGED[:1], flags="is") + _with(SECRETS, LOGGED[1:]), "high", 0.9),
]
