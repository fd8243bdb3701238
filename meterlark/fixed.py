"""Fixed values that results depend on: price entries, publishers, capacities, evidence sets, vocabularies."""

#: The dated reference catalog.
REFERENCE_CATALOG = {"name": "foundry-reference-2026-09-14", "currency": "USD", "basis": "analysis_date_snapshot", "retrieved_at": "2026-09-14"}
PROVIDER = "azure_foundry"
#: Model, region, input, cached input and output per million tokens.
REFERENCE_PRICES = [
    ("phi-3-mini-4k-instruct", "global", 0.13, None, 0.52),
    ("phi-3-mini-128k-instruct", "global", 0.13, None, 0.52),
    ("phi-3.5-mini-instruct", "global", 0.13, None, 0.52),
    ("phi-3-small-8k-instruct", "global", 0.15, None, 0.60),
    ("phi-3-small-128k-instruct", "global", 0.15, None, 0.60),
    ("phi-3-medium-4k-instruct", "global", 0.17, None, 0.68),
    ("phi-3-medium-128k-instruct", "global", 0.17, None, 0.68),
    ("phi-3.5-moe-instruct", "global", 0.16, None, 0.64),
    ("phi-4", "global", 0.125, None, 0.50),
    ("phi-4-mini", "global", 0.075, None, 0.30),
    ("phi-4-mini-reasoning", "global", 0.075, None, 0.30),
    ("phi-4-reasoning", "global", 0.125, None, 0.50),
    ("phi-4-reasoning-plus", "global", 0.125, None, 0.50),
    ("mai-ds-r1", "global", 1.35, None, 5.40),
    ("mai-ds-r1", "regional", 1.485, None, 5.94),
    ("mai-thinking-1", "global", 2.0, 0.20, 8.0),
    ("mai-cyber-1-flash", "global", 0.60, 0.06, 3.50),
]

#: First prefix that fits names the publisher.
PUBLISHER_PREFIXES = [
    ("claude-", "anthropic"),
    ("ministral-", "mistral"),
    ("mistral-", "mistral"),
    ("llama-", "meta"),
    ("meta-llama", "meta"),
    ("deepseek-", "deepseek"),
    ("gemini-", "google"),
    ("gemma-", "google"),
    ("cohere-", "cohere"),
    ("command-", "cohere"),
    ("gpt-", "microsoft"),
    ("o1", "microsoft"),
    ("o3-", "microsoft"),
    ("o4-", "microsoft"),
    ("phi-", "microsoft"),
    ("mai-", "microsoft"),
]

#: Rule, title, whether buckets can feed it, and the sets of evidence of which one must be whole.
RULES = [
    ("TL001", "Repeated system prefix", False, [["system_prompt_fingerprint", "system_prompt_tokens"], ["messages"]]),
    ("TL002", "Conversation-history growth", False, [["messages"]]),
    ("TL003", "Unused tool definitions", False, [["tools"]]),
    ("TL004", "Retrieval redundancy", False, [["retrieved_chunks"]]),
    ("TL005", "Retry amplification", True, [["retry_of"], ["retry_count"], ["messages"]]),
    ("TL006", "Output budget over-allocation", False, [["max_output_tokens", "output_tokens"]]),
    ("TL007", "Semantic-cache opportunity", False, [["messages"]]),
    ("TL008", "Possible model over-sizing", False, [["model_identity", "messages"], ["model_identity", "task_shape_evidence"]]),
]
#: Severity of each rule's finding.
SEVERITY = {"TL001": "high", "TL002": "medium", "TL003": "medium", "TL004": "medium", "TL005": "high", "TL006": "medium", "TL007": "medium", "TL008": "low"}
#: Words that mark a bounded task.
BOUNDED_TERMS = ["classify", "extract", "format as json", "yes or no", "categorize"]

#: Model, quota in tokens a minute, input tokens a minute a unit, output ratio, least and step of units (global, then regional).
CAPACITIES = [
    ("gpt-5.5", 450_000, 1200, 6, 15, 5, 50, 50),
    ("gpt-5.4-mini", 450_000, 7900, 6, 15, 5, 25, 25),
    ("gpt-5.4", 450_000, 2400, 6, 15, 5, 50, 50),
    ("gpt-5.3-codex", 450_000, 3400, 8, 15, 5, 50, 50),
    ("gpt-5.2-codex", 450_000, 3400, 8, 15, 5, 50, 50),
    ("gpt-5.2", 450_000, 3400, 8, 15, 5, 50, 50),
    ("gpt-5.1-codex", 450_000, 4750, 8, 15, 5, 50, 50),
    ("gpt-5.1", 450_000, 4750, 8, 15, 5, 50, 50),
    ("gpt-5-mini", 450_000, 23750, 8, 15, 5, 25, 25),
    ("gpt-5", 450_000, 4750, 8, 15, 5, 50, 50),
    ("gpt-4.1", 720_000, 3000, 4, 15, 5, 50, 50),
    ("gpt-4.1-mini", 2_000_000, 14900, 4, 15, 5, 25, 25),
    ("gpt-4.1-nano", 4_000_000, 59400, 4, 15, 5, 25, 25),
    ("gpt-4o", 450_000, 2500, 4, 15, 5, 50, 50),
    ("gpt-4o-mini", 2_000_000, 37000, 4, 15, 5, 25, 25),
    ("o1", 450_000, 230, 4, 15, 5, 25, 50),
    ("o3-mini", 2_000_000, 2500, 4, 15, 5, 25, 25),
    ("o4-mini", 2_000_000, 5400, 4, 15, 5, 25, 25),
]
#: Active buckets needed by the advisor, and by a collection's summary.
ADVISOR_ACTIVE_BUCKETS = 100
COLLECTION_ACTIVE_BUCKETS = 2016
#: Weights of the evidence score.
CONFIDENCE_WEIGHTS = {"active": 0.30, "lookback": 0.18, "completeness": 0.15, "outcomes": 0.10, "latency": 0.10, "pricing": 0.10, "identity": 0.02, "capacity": 0.03, "mode": 0.02}

#: Fragments of names that mark content.
CONTENT_FRAGMENTS = ["prompt", "completion", "message", "messages", "content", "input", "output", "text", "arguments", "tool_call", "tool_result", "document", "chunk", "embedding", "header", "authorization", "api_key", "apikey", "token_value", "secret", "password", "cookie", "connection_string", "endpoint", "url", "uri", "ip", "user_id", "tenant", "subscription"]
#: Span attributes that may be kept, beside the library's own ``deployment_mode`` and ``workload``.
SPAN_ATTRIBUTES = [
    "gen_ai.system",
    "gen_ai.provider.name",
    "gen_ai.operation.name",
    "gen_ai.request.model",
    "gen_ai.response.model",
    "gen_ai.request.max_tokens",
    "gen_ai.request.service_tier",
    "gen_ai.response.service_tier",
    "gen_ai.usage.input_tokens",
    "gen_ai.usage.output_tokens",
    "gen_ai.usage.prompt_tokens",
    "gen_ai.usage.completion_tokens",
    "gen_ai.usage.cached_input_tokens",
    "gen_ai.usage.reasoning_tokens",
    "gen_ai.azure.deployment_name",
    "gen_ai.openai.request.service_tier",
    "az.deployment.mode",
    "server.address",
    "error.type",
    "http.response.status_code",
]
#: Names of metric dimensions, any case, and what they stand for.
DIMENSIONS = {
    "modeldeploymentname": "ModelDeploymentName",
    "deploymentname": "ModelDeploymentName",
    "modelname": "ModelName",
    "model": "ModelName",
    "modelversion": "ModelVersion",
    "statuscode": "StatusCode",
    "servicetierrequest": "ServiceTierRequest",
    "servicetierresponse": "ServiceTierResponse",
    "region": "Region",
    "apiname": "ApiName",
    "operationname": "OperationName",
    "contextlength": "ContextLength",
    "streamtype": "StreamType",
}
#: Words of meter labels that exclude a meter, and why.
METER_EXCLUDED = {
    "ft": "fine-tuning", "finetune": "fine-tuning", "finetuned": "fine-tuning", "finetuning": "fine-tuning", "ftune": "fine-tuning",
    "batch": "batch", "bat": "batch", "btch": "batch",
    "pp": "priority-processing", "priority": "priority-processing",
    "prov": "provisioned", "provisioned": "provisioned", "ptu": "provisioned",
    "reserved": "reservation", "reservation": "reservation",
    "fl": "flex", "flex": "flex",
    "image": "media", "images": "media", "audio": "media", "speech": "media", "video": "media", "vision": "media", "media": "media",
    "tool": "tool", "tools": "tool",
    "session": "session", "sessions": "session", "realtime": "session",
    "hosting": "hosted-deployment-unit", "unit": "hosted-deployment-unit", "units": "hosted-deployment-unit", "hour": "hosted-deployment-unit",
    "page": "non-token-meter", "pages": "non-token-meter", "character": "non-token-meter", "characters": "non-token-meter", "minute": "non-token-meter", "minutes": "non-token-meter",
}
#: Words of meter labels and what they state.
METER_WORDS = {
    "inp": "input", "in": "input", "input": "input", "inputs": "input",
    "opt": "output", "out": "output", "outp": "output", "output": "output", "outputs": "output",
    "cd": "cache", "cache": "cache", "cached": "cache", "caching": "cache",
    "wr": "write", "write": "write", "writes": "write",
    "gl": "global", "gbl": "global", "glbl": "global", "global": "global",
    "dz": "data_zone", "dzone": "data_zone", "datazone": "data_zone", "dzn": "data_zone",
    "reg": "regional", "regnl": "regional", "regional": "regional",
    "shco": "short", "shortco": "short", "short": "short", "shortcontext": "short",
    "loco": "long", "longco": "long", "long": "long", "longcontext": "long",
    "std": "standard", "standard": "standard",
    "tokens": "noise", "token": "noise", "model": "noise", "models": "noise", "1m": "noise", "1k": "noise", "10k": "noise", "100k": "noise", "1": "noise",
}

#: Canonical model, aliases, modality, usage bases, commerce type, whether provisioned capacity can be bought (None: not known).
CAPABILITY_VERSION = "2026-10-06.2"
CAPABILITIES = [
    ("gpt-4o", ["gpt-4o", "gpt-4o-2024-05-13", "gpt-4o-2024-08-06", "gpt-4o-2024-11-20"], "text", ["input_tokens", "cached_input_tokens", "output_tokens"], "azure_direct", True),
    ("gpt-4.1", ["gpt-4.1", "gpt-4.1-mini", "gpt-4.1-nano", "gpt-4.1-2025-04-14"], "text", ["input_tokens", "cached_input_tokens", "output_tokens"], "azure_direct", True),
    ("gpt-5", ["gpt-5", "gpt-5-mini", "gpt-5-nano", "gpt-5-chat", "gpt-5.1", "gpt-5.4", "gpt-5.6-luna"], "text", ["input_tokens", "cached_input_tokens", "output_tokens"], "azure_direct", True),
    ("text-embedding", ["text-embedding-3-large", "text-embedding-3-small", "text-embedding-ada-002"], "embedding", ["input_tokens"], "azure_direct", False),
    ("tts-1", ["tts", "tts-1", "tts-1-hd", "gpt-4o-mini-tts"], "text_to_speech", ["characters", "audio_seconds"], "azure_direct", False),
    ("whisper", ["whisper", "whisper-1", "gpt-4o-transcribe", "gpt-4o-mini-transcribe"], "speech_to_text", ["audio_seconds", "audio_hours"], "azure_direct", False),
    ("gpt-4o-audio", ["gpt-4o-audio-preview", "gpt-4o-mini-audio-preview"], "audio", ["input_tokens", "output_tokens", "audio_seconds"], "azure_direct", False),
    ("gpt-4o-realtime", ["gpt-4o-realtime-preview", "gpt-4o-mini-realtime-preview"], "audio", ["input_tokens", "output_tokens", "audio_seconds"], "azure_direct", False),
    ("dall-e", ["dall-e-3", "dall-e-2", "gpt-image-1"], "image", ["images", "megapixels", "input_tokens", "output_tokens"], "azure_direct", False),
    ("sora", ["sora", "sora-1", "sora-2"], "video", ["video_seconds"], "azure_direct", False),
    ("claude", ["claude", "claude-3-5-sonnet", "claude-sonnet-4", "claude-opus-4"], "text", ["input_tokens", "output_tokens"], "marketplace", False),
    ("grok", ["grok", "grok-4", "grok-4.1", "grok-4.6"], "text", ["input_tokens", "cached_input_tokens", "output_tokens"], "azure_direct", None),
    ("mistral", ["mistral", "mistral-small", "mistral-large", "ministral-3b", "mixtral-8x7b"], "text", ["input_tokens", "cached_input_tokens", "output_tokens"], "azure_direct", None),
    ("flux-image", ["flux.1-kontext-pro", "flux.1-schnell"], "image", ["images", "megapixels"], "unknown", False),
    ("model-router", ["model-router", "model-router-global"], "router", ["input_tokens", "cached_input_tokens", "output_tokens"], "azure_direct", False),
    ("fine-tuned", ["fine-tuned", "fine_tuned", "fine-tuning"], "text", ["input_tokens", "cached_input_tokens", "output_tokens", "training_tokens", "training_hours", "hosting_hours"], "azure_direct", False),
    ("managed-compute", ["managed-compute", "managed_compute", "managed compute"], "managed_compute", ["compute_hours", "hosting_hours", "requests"], "managed_compute", False),
]
#: Names of deployment offers and their modes; the whole name first, then a beginning or an end in this order.
OFFER_MODES = [
    ("globalprovisionedmanaged", "global_provisioned"),
    ("datazoneprovisionedmanaged", "data_zone_provisioned"),
    ("provisionedmanaged", "regional_provisioned"),
    ("globalbatch", "batch"),
    ("datazonebatch", "batch"),
    ("globalstandard", "global"),
    ("datazonestandard", "data_zone"),
    ("standard", "regional"),
    ("batch", "batch"),
]
#: Provider family of each publisher.
FAMILIES = {"microsoft": "azure_openai", "openai": "azure_openai", "anthropic": "claude_foundry", "mistral": "partner_model", "meta": "partner_model", "cohere": "partner_model", "deepseek": "partner_model", "google": "partner_model", "ai21": "partner_model"}
#: Metric, field, aggregation, priority, whether it can be filtered by deployment, whether it has status codes.
METRICS = [
    ("InputTokens", "input_tokens", "Total", 0, True, False),
    ("ProcessedPromptTokens", "input_tokens", "Total", 1, True, False),
    ("PromptTokenCount", "input_tokens", "Total", 2, True, False),
    ("OutputTokens", "output_tokens", "Total", 0, True, False),
    ("GeneratedTokens", "output_tokens", "Total", 1, True, False),
    ("CompletionTokenCount", "output_tokens", "Total", 2, True, False),
    ("ModelRequests", "requests", "Total", 0, True, True),
    ("AzureOpenAIRequests", "requests", "Total", 1, True, True),
    ("TotalCalls", "requests", "Total", 2, False, True),
    ("SuccessfulCalls", "successful_requests", "Total", 0, False, True),
    ("ThrottledCalls", "throttled_requests", "Total", 0, True, False),
    ("AzureOpenAIThrottledRequests", "throttled_requests", "Total", 1, True, False),
    ("TotalErrors", "failed_requests", "Total", 0, False, True),
    ("ClientErrors", "failed_requests", "Total", 1, False, True),
    ("ServerErrors", "failed_requests", "Total", 2, False, True),
    ("AzureOpenAITimeToResponse", "average_latency_ms", "Average", 0, True, True),
    ("TimeToResponse", "average_latency_ms", "Average", 1, True, True),
    ("AzureOpenAINormalizedTTFTInMS", "average_latency_ms", "Average", 2, True, False),
    ("NormalizedTimeToFirstByte", "average_latency_ms", "Average", 3, True, False),
    ("Latency", "average_latency_ms", "Average", 4, False, True),
]
#: Names of error types and their categories.
ERROR_TYPES = {"ratelimiterror": "rate_limited", "rate_limit": "rate_limited", "429": "rate_limited", "authenticationerror": "authentication", "401": "authentication", "permissiondeniederror": "authorization", "403": "authorization", "notfounderror": "not_found", "404": "not_found", "badrequesterror": "bad_request", "400": "bad_request", "timeout": "timeout", "timeouterror": "timeout", "408": "timeout", "connectionerror": "connection", "internalservererror": "server_error", "500": "server_error", "503": "server_error"}
#: Names that a stored record must never have, and the parts of a record whose names are measurements.
FORBIDDEN_KEYS = ["messages", "prompt", "prompt_text", "completion", "response_text", "system_prompt", "tools", "tool_arguments", "retrieved_chunks", "headers", "api_key", "authorization", "endpoint", "connection_string", "subscription_id", "tenant_id", "request_id"]
MEASUREMENT_PARTS = ["content_features", "fingerprints"]
FINGERPRINT_PREFIX = "hmac-sha256:"
#: Spellings of price dimensions.
UNSTATED = ["", "unknown", "none", "unspecified", "null"]
DEPLOYMENT_SPELLINGS = {"global": "global", "globalstandard": "global", "global_standard": "global", "gl": "global", "glbl": "global", "data_zone": "data_zone", "datazone": "data_zone", "data_zone_standard": "data_zone", "datazonestandard": "data_zone", "dz": "data_zone", "dzone": "data_zone", "regional": "regional", "regionalstandard": "regional", "regional_standard": "regional", "regnl": "regional", "reg": "regional"}
CONTEXT_SPELLINGS = {"short": "short", "short_context": "short", "shortcontext": "short", "shortco": "short", "shco": "short", "long": "long", "long_context": "long", "longcontext": "long", "longco": "long", "loco": "long"}
TIER_SPELLINGS = {"standard": "standard", "std": "standard"}
INFERENCE_SPELLINGS = {"normal": "normal", "standard": "normal", "normal_inference": "normal"}
#: Published token prices are multiplied by these; a consumption unit costs this many dollars.
MODE_MULTIPLIERS = {"global": 1.0, "data_zone": 1.1}
DOLLARS_PER_UNIT = 0.01
#: Version of stored snapshots, and days after which one is stale.
SNAPSHOT_VERSION = 2
SNAPSHOT_DAYS = 7
