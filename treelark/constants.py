"""Numbers and name lists that the operators share."""

K1, B = 1.5, 0.75
ZONE_WEIGHTS = {"summary": 3.0, "decisions": 2.5, "symbols": 2.0, "constraints": 1.5, "state": 1.0, "facets": 0.7, "path": 0.5}
STOPWORDS = sorted("i us we no not was are be as at on for it is or of an a the this that were with your you by to in and".split())
ALPHA, BETA, MUST = 0.55, 0.35, 0.05
BUDGET, ROOT_RESERVE, TIER_SHARE, FREE_SLOTS, MAX_SCOPES = 4000, 200, 0.85, 3, 20
PROXIMITY_HOPS, IMPACT_DEPTH, IMPACT_RESULTS = 4, 3, 100
MIN_TOKENS, BYTES_PER_TOKEN = 4096, 4
RESPONSE_CHARS, RESULT_CAP, VIOLATION_CAP = 10_240, 50, 500
CAPS = {"exports": 25, "interfaces": 15, "imports": 20, "internals": 20, "dependencies": 20, "environment": 50, "testing": 15, "config": 30, "todos": 10, "events": 20, "models": 20, "model_fields": 8, "failing_tests": 50}

IGNORED_DIRS = sorted(
    "vendor venv tmp temp target storybook-static out obj node_modules dist coverage build bower_components _site _build __pycache__ Pods "
    ".vercel .venv .turbo .tox .svelte-kit .pytest_cache .nuxt .next .mypy_cache .git .cache".split()
)
SPECIAL_FILES = sorted("setup.py setup.cfg pyproject.toml go.mod docker-compose.yml docker-compose.yaml Rakefile Makefile Gemfile Dockerfile Cargo.toml CMakeLists.txt".split())
SOURCE_EXTENSIONS = sorted(
    {"." + x for x in "zsh yml yaml xml vue txt tsx ts toml tf swift svelte sql sh scss scala rst rs rb r pyi py proto php mjs mdx md lua kts kt jsx json js java html hs hpp hcl h graphql gql go exs ex dockerfile css cs cpp cjs cc c bash".split()}
)
INDEX_KINDS = ("function", "class", "interface", "type", "enum", "const", "method", "default")
