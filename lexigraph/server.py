"""The search page over HTTP; requests are answered one after the other."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import quote_plus

from lexigraph.functions.web import escape, query_parameter

LOOK = "body{max-width:48rem;margin:2rem auto;font:16px/1.5 Georgia,serif}li{margin:1rem 0}small{color:#555}"


def page(content: str, heading: str = "lexigraph") -> str:
    return f'<!doctype html>\n<html lang="en"><meta charset="utf-8"><title>{escape(heading)}</title><style>{LOOK}</style>\n<main>{content}</main></html>'


def ask(text: str = "") -> str:
    return f'<form><label>Find <input name="q" size="50" value="{escape(text)}"></label> <button>Go</button></form>'


def start_page() -> str:
    return page(f"{ask()}<p>Words, or <code>phrase:</code>, <code>bool:</code>, <code>fuzzy:</code> and <code>spell:</code> before them.</p>")


def entry(row) -> str:
    """One hit as an item of the list: title (a link if it is on the web), text, place and score."""
    title = escape(row.title or row.path or "untitled")
    if (row.path or "").startswith(("http://", "https://")):
        title = f'<a href="{escape(row.path)}">{title}</a>'
    return f'<li value="{row.rank}"><article><h2>{title}</h2><p>{escape(row.snippet)}</p><small>{escape(row.path or "")} · {row.score:.3f}</small></article></li>'


def answer_page(answer, text: str) -> str:
    hint = ""
    if answer.suggestion:
        done = answer.mode == "spell-corrected"
        hint = f'<p>{"These are hits for" if done else "Perhaps you want"} <a href="?q={quote_plus(answer.suggestion)}">{escape(answer.suggestion)}</a>.</p>'
    notes = "".join(f"<li>{escape(n)}</li>" for n in answer.notes)
    hits = f"<ol>{''.join(map(entry, answer.rows))}</ol>" if answer.rows else "<p>Nothing matches.</p>"
    return page(f"{ask(text)}{hint}<ul>{notes}</ul>{hits}<footer><small>{len(answer.rows)} hits, {answer.mode}, {answer.seconds:.2f} s</small></footer>", text)


def respond(engine, target: str) -> tuple[int, str]:
    """Status and page of a GET request."""
    path, _, query = target.partition("?")
    if path != "/":
        return 404, page("<p>There is no such page.</p>")
    text = query_parameter(query).strip()
    return 200, answer_page(engine.web_query(text), text) if text else start_page()


def serve(engine, port: int = 8080) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, text = respond(engine, self.path)
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    HTTPServer(("0.0.0.0", port), Handler).serve_forever()
