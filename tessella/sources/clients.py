"""Requests to public services and what is read from their answers; the call itself is passed in.

A service is a row of SERVICES: where a value is asked for, where in the answer its match stands,
and which parts of it become fields. fetch(url, body, headers) gives the answer's JSON, raising
OSError where the call failed; fetch_json is one over HTTP, and tests and queries pass their own.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from tessella.operators.extraction import Lookup

Fetch = Callable[[str, dict | None, dict], object]


@dataclass(frozen=True)
class Service:
    """url and query have {value} and the mapping's parameters in braces; a query entry whose parameter is missing is left out."""

    url: str
    query: dict[str, str] = field(default_factory=dict)
    match: tuple[str | int, ...] = ()
    fields: dict[str, tuple[str | int, ...]] = field(default_factory=dict)
    unless: tuple[str, str] | None = None  # a field whose value says that nothing matched
    headers: dict[str, str] = field(default_factory=dict)
    needs: tuple[str, ...] = ()  # parameters without which it isn't asked
    given: dict[str, tuple[str, str]] = field(default_factory=dict)  # a parameter that changes a query entry, and its form then
    made: dict[str, str] = field(default_factory=dict)  # further fields, from those of the answer


# Addresses and answers of the public services.
SERVICES = {
    "taxon": Service("https://api.gbif.org/v1/species/match", {"name": "{value}"}, (), {
        "matched_name": ("canonicalName",), "scientific_name": ("scientificName",), "rank": ("rank",), "kingdom": ("kingdom",), "phylum": ("phylum",), "class": ("class",), "order": ("order",),
        "family": ("family",), "genus": ("genus",), "gbif_id": ("usageKey",), "confidence": ("confidence",), "match_type": ("matchType",), "status": ("status",),
    }, ("matchType", "NONE")),
    "plant": Service("http://www.worldfloraonline.org/api/1.0/search", {"query": "{value}"}, ("results", 0), {
        "matched_name": ("name",), "scientific_name": ("scientificName",), "authors": ("authors",), "family": ("family",), "wfo_id": ("wfoId",), "status": ("status",),
    }),
    "place": Service("http://api.geonames.org/searchJSON", {"q": "{value}", "maxRows": "1", "username": "{username}", "country": "{country}"}, ("geonames", 0), {
        "matched_name": ("name",), "country": ("countryName",), "country_code": ("countryCode",), "admin1": ("adminName1",), "admin2": ("adminName2",), "latitude": ("lat",), "longitude": ("lng",), "geonames_id": ("geonameId",),
    }, needs=("username",)),
    "address": Service("https://nominatim.openstreetmap.org/search", {"q": "{value}", "format": "json", "limit": "1"}, (0,), {
        "display_name": ("display_name",), "latitude": ("lat",), "longitude": ("lon",), "osm_type": ("osm_type",), "osm_id": ("osm_id",), "place_rank": ("place_rank",),
    }, headers={"User-Agent": "tessella"}),
    "compound": Service("https://pubchem.ncbi.nlm.nih.gov/rest/pug/compound/name/{value}/JSON", {}, ("PC_Compounds", 0), {"cid": ("id", "id", "cid"), "molecular_formula": ("props", 0, "value", "sval")}, made={"pubchem_url": "https://pubchem.ncbi.nlm.nih.gov/compound/{cid}"}),
    "gene": Service("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", {"db": "gene", "term": "{value}", "retmode": "json"}, ("esearchresult", "idlist"), {"gene_id": (0,)}, given={"organism": ("term", "{value}[Gene Name] AND {organism}[Organism]")}, made={"ncbi_url": "https://www.ncbi.nlm.nih.gov/gene/{gene_id}"}),
}


def fetch_json(url: str, body: dict | None, headers: dict, timeout: float = 15.0) -> object:
    """One call over HTTP; what the service doesn't know (404) is no answer, all other failures raise OSError."""
    data = None if body is None else json.dumps(body).encode()
    call = urllib.request.Request(url, data, {**headers, **({"Content-Type": "application/json"} if body is not None else {})})
    try:
        with urllib.request.urlopen(call, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise
    except ValueError as e:
        raise OSError(f"no JSON from {url}") from e


def part(answer: object, path: tuple[str | int, ...]) -> object:
    """What lies at a path of keys and places, or None."""
    for step in path:
        if isinstance(step, int):
            answer = answer[step] if isinstance(answer, list) and len(answer) > step else None
        else:
            answer = answer.get(step) if isinstance(answer, dict) else None
    return answer


def request_url(service: Service, value: str, parameters: dict) -> str:
    """The address that asks a service for a value."""
    query = {}
    for name, form in service.query.items():
        if form == "{value}":
            query[name] = value
        elif form[:1] != "{":
            query[name] = form
        elif parameters.get(form[1:-1]):
            query[name] = str(parameters[form[1:-1]])
    for name, (entry, form) in service.given.items():
        if parameters.get(name):
            query[entry] = form.replace("{value}", value).replace(f"{{{name}}}", str(parameters[name]))
    url = service.url.replace("{value}", urllib.parse.quote(value, safe=""))
    return f"{url}?{urllib.parse.urlencode(query)}" if query else url


def lookup_of(name: str, fetch: Fetch = fetch_json) -> Lookup:
    """A service as a lookup for enriched(): value and parameters to fields, None where nothing matches."""
    service = SERVICES[name]

    def call(value: str, parameters: dict) -> dict | None:
        if any(not parameters.get(n) for n in service.needs):
            return None
        found = part(fetch(request_url(service, value, parameters), None, service.headers), service.match)
        if not found or (service.unless and part(found, service.unless[:1]) == service.unless[1]):
            return None
        made = {n: part(found, path) for n, path in service.fields.items()}
        told = {n: None if v is None else str(v) for n, v in made.items()}
        return told | {n: form.format(**told) for n, form in service.made.items()}

    return call


def schema_of(name: str) -> str:
    return ", ".join(f"`{n}` string" for n in (*SERVICES[name].fields, *SERVICES[name].made))


# ---- language models and page recognition


def extraction_request(model: str, prompt: str, document: str, system: str = "You are a scientific research assistant.", most_tokens: int = 16384) -> dict:
    """What asks a language model to read a PDF (base 64) under a prompt."""
    source = {"type": "base64", "media_type": "application/pdf", "data": document}
    content = [{"type": "document", "source": source}, {"type": "text", "text": prompt}]
    return {"model": model, "max_tokens": most_tokens, "temperature": 0, "system": system, "messages": [{"role": "user", "content": content}]}


def extraction_answer(answer: object) -> dict | None:
    """Text and tokens of a language model's answer."""
    said = part(answer, ("content", 0, "text"))
    return None if said is None else {"text": said, "input_tokens": part(answer, ("usage", "input_tokens")), "output_tokens": part(answer, ("usage", "output_tokens"))}


def page_request(kind: str, host: str, model: str, prompt: str, image: str, api_key: str | None = None) -> tuple[str, dict, dict]:
    """Address, body and headers that ask for a page's text: kind generate (one prompt, images beside it) or chat."""
    base = (host if host.startswith(("http://", "https://")) else f"http://{host}").rstrip("/")
    if kind == "generate":
        return f"{base}/api/generate", {"model": model, "prompt": prompt, "images": [image], "stream": False, "options": {"num_ctx": 8192}}, {}
    content = [{"type": "image_url", "image_url": {"url": f"data:image/png;base64,{image}"}}, {"type": "text", "text": prompt}]
    body = {"model": model, "messages": [{"role": "user", "content": content}], "max_tokens": 8192, "stream": False}
    return f"{base}/v1/chat/completions", body, {"Authorization": f"Bearer {api_key}"} if api_key else {}


def page_answer(kind: str, answer: object) -> str:
    found = part(answer, ("response",)) if kind == "generate" else part(answer, ("choices", 0, "message", "content"))
    return found or ""


def page_reader(kind: str, host: str, model: str, prompt: str, fetch: Fetch = fetch_json, api_key: str | None = None) -> Callable[[dict], dict]:
    """A call for resume(): a row's image (base 64) to its text."""

    def call(row: dict) -> dict:
        url, body, headers = page_request(kind, host, model, prompt, row["image"], api_key)
        return {"text": page_answer(kind, fetch(url, body, headers))}

    return call


def assembly_query(taxon: str, most: int, filtered: bool, reference_only: bool = False) -> list[str]:
    """The command that lists a taxon's assemblies as JSON lines: five times as many where they are filtered afterwards."""
    return ["datasets", "summary", "genome", "taxon", taxon, "--limit", str(most * 5 if filtered else most), "--as-json-lines", *(["--reference", "--annotated"] if reference_only else [])]
