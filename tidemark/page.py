"""The page that a browser is shown: it asks the JSON interface for everything else."""

PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>tidemark</title>
<style>
body { font: 14px/1.4 system-ui, sans-serif; margin: 1.5rem; max-width: 80rem }
input[name=query] { width: 30rem } table { border-collapse: collapse; margin-top: 1rem } td, th { text-align: left; padding: .2rem .8rem; border-bottom: 1px solid #ddd; vertical-align: top }
pre { margin: 0; white-space: pre-wrap } .wrong { color: #a00 }
</style></head><body>
<h1><a href="/">tidemark</a></h1>
<form id="form"><input name="query" placeholder="error (disk OR ~sd[a-z]) !retry" required>
<input name="fromDate" placeholder="from, 2024-07-01T00:00:00Z"> <input name="toDate" placeholder="to">
<select name="pruning"><option>prefix<option>exact<option>none</select> <button>Search</button> <span id="wrong" class="wrong"></span></form>
<div id="said"></div>
<script>
const at = location.pathname.match(/^\\/query\\/(\\d+)$/), size = 100, said = document.getElementById("said")
const cell = (row, text, kind = "td") => row.appendChild(document.createElement(kind)).textContent = text ?? ""
const table = (names, rows) => { const t = document.createElement("table"), h = t.insertRow(); names.forEach(n => cell(h, n, "th")); rows.forEach(r => t.appendChild(r)); return t }
document.getElementById("form").onsubmit = async e => {
  e.preventDefault()
  const answer = await fetch("/api/query", { method: "POST", body: JSON.stringify(Object.fromEntries(new FormData(e.target))) }), found = await answer.json()
  if (answer.ok) location = "/query/" + found.query.query_id
  else document.getElementById("wrong").textContent = found.error
}
async function list() {
  const rows = (await (await fetch("/api/query")).json()).map(q => {
    const row = document.createElement("tr"), link = row.insertCell().appendChild(document.createElement("a"))
    link.href = "/query/" + q.query_id; link.textContent = q.text
    for (const v of [q.date_min, q.date_max, q.messages, q.failed ? "failed" : q.finished ? "done" : "running", q.built_at]) cell(row, v)
    return row
  })
  said.replaceChildren(table(["query", "from", "to", "messages", "state", "asked"], rows))
}
async function show(wait) {
  const skip = Number(new URLSearchParams(location.search).get("skip") || 0)
  const { query, messages } = await (await fetch(`/api/query/${at[1]}?skip=${skip}&limit=${size}`)).json()
  if (!query) return said.textContent = "no such query"
  const head = document.createElement("p"), nav = document.createElement("p"), pages = Math.max(1, Math.ceil(query.messages / size))
  head.textContent = `${query.text}: ${query.messages} messages${query.failed ? ", failed" : query.finished ? "" : " so far"}`
  nav.append(`page ${skip / size + 1} of ${pages} `)
  for (const [name, to] of [["before", skip - size], ["next", skip + size]]) if (to >= 0 && to < query.messages) { const a = document.createElement("a"); a.href = `?skip=${to}`; a.textContent = name; nav.append(a, " ") }
  const rows = messages.map(m => { const row = document.createElement("tr"); cell(row, m.date); cell(row, m.file + ":" + m.pos); row.insertCell().appendChild(document.createElement("pre")).textContent = m.body; return row })
  said.replaceChildren(head, table(["date", "place", "message"], rows), nav)
  if (!query.finished && !query.failed) setTimeout(() => show(wait * 1.2), wait)
}
at ? show(500) : list()
</script></body></html>
"""
