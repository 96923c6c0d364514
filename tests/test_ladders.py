"""The device's and the journey's ladders on small pages with known answers."""

from __future__ import annotations

from sluice.operators import ladders

ELEMENT = "snapshot_id string, id string, role string, text string, label string, input_type string, value_handle string, enabled boolean, selected boolean, value_present boolean, options array<string>, selected_option string, control_value string, dom_index int, sources array<string>"
NAMES = [x.split()[0] for x in ELEMENT.split(", ")]


def el(s, i, role, **more):
    row = dict.fromkeys(NAMES) | {"snapshot_id": s, "id": f"el_{i}", "role": role, "enabled": True, "value_present": False, "dom_index": i, "sources": ["DOM"]} | more
    return tuple(row[n] for n in NAMES)


CASES = {
    # task, elements, expected (rule, type, element, handle, option, direction)
    "none": ("compare the fares and click next", [("button", {"label": "Next"})], None),
    "talk": ("what is this", [("button", {"label": "Next"})], None),
    "fill": ("Fill LOCAL_EMAIL_1 in", [("textbox", {"label": "Other"}), ("textbox", {"label": "Mail", "value_handle": "LOCAL_EMAIL_1"})], ("FILL", "TYPE_HANDLE", "el_1", "LOCAL_EMAIL_1", None, None)),
    "kind": ("please enter my phone", [("textbox", {"label": "Mobile", "value_handle": "LOCAL_PHONE_1"})], ("FILL", "TYPE_HANDLE", "el_0", "LOCAL_PHONE_1", None, None)),
    "other": ("please enter my email", [("textbox", {"label": "Mobile", "value_handle": "LOCAL_PHONE_1"})], None),
    "choose": ("select Python", [("combobox", {"options": ["Java", "Python"], "selected_option": "Java"})], ("CHOOSE", "SELECT", "el_0", None, "Python", None)),
    "chosen": ("select Python", [("combobox", {"options": ["Java", "Python"], "selected_option": "Python"})], ("SATISFIED", "FINISH", None, None, None, None)),
    "ordinal": ("check the second checkbox", [("checkbox", {"selected": False}), ("checkbox", {"selected": False})], ("ORDINAL", "CLICK", "el_1", None, None, None)),
    "missing": ("check the third checkbox", [("checkbox", {"selected": False})], None),
    "state": ("uncheck news letter", [("checkbox", {"label": "News-letter", "selected": True})], ("NAMED_STATE", "CLICK", "el_0", None, None, None)),
    "settled": ("tick terms", [("checkbox", {"label": "Terms", "selected": True})], ("SATISFIED", "FINISH", None, None, None, None)),
    "scroll": ("scroll down please", [], ("SCROLL", "SCROLL", None, None, None, "DOWN")),
    "button": ("click the Send it", [("button", {"text": "Send it"}), ("button", {"text": "Send it", "enabled": False})], ("NAMED_BUTTON", "CLICK", "el_0", None, None, None)),
    "direct": ("use the form and continue", [("button", {"text": "Continue"})], ("NAMED_BUTTON", "CLICK", "el_0", None, None, None)),
    "unnamed": ("use send it", [("button", {"text": "Send it"})], None),
    "submit": ("click submit later but never click the submit", [("button", {"text": "Submit"})], None),
    "handles": ("type LOCAL_EMAIL_1 and LOCAL_OTP_1", [("textbox", {"label": "email", "value_present": True}), ("textbox", {"label": "otp", "value_present": True})], ("SATISFIED", "FINISH", None, None, None, None)),
    "half": ("type LOCAL_EMAIL_1 and LOCAL_OTP_1", [("textbox", {"label": "email", "value_present": True})], None),
    "filled": ("enter the address", [("textbox", {"label": "Address", "value_present": True})], ("SATISFIED", "FINISH", None, None, None, None)),
}


def test_device_ladder(spark):
    rows = [el(s, i, role, **more) for s, (_, own, _) in CASES.items() for i, (role, more) in enumerate(own)]
    rows += [el("sum", 0, "button", label="Go", text="now"), el("sum", 1, "visual_text", text="read me", sources=["OCR"]), el("sum", 2, "visual_text", text="read me", sources=["OCR"])]
    tasks = [(s, task) for s, (task, _, _) in CASES.items()] + [("sum", "Summarise the visible page"), ("nil", "describe this screen")]
    found = {r["snapshot_id"]: r for r in ladders.on_device(spark.createDataFrame(rows, ELEMENT), spark.createDataFrame(tasks, "snapshot_id string, task string")).collect()}
    got = {s: tuple(r[n] for n in ("rule", "type", "element_id", "handle", "option", "direction")) for s, r in found.items()}
    for s, (_, _, want) in CASES.items():
        assert got.get(s) == want, s
    assert found["scroll"]["amount"] == 700
    assert found["sum"]["summary"] == "Local screen analysis found 1 interactive elements and 2 pixel-derived records. Visible controls include Go now. Sanitized visual text: read me."
    assert found["nil"]["summary"].startswith("Local screen analysis found 0 ")


TRIP = {"from": "Pune", "to": "Goa", "date": "2026-11-07", "travel_class": "Sleeper", "quota": "General", "age": "30", "gender": "Female", "berth": "Lower"}
box = lambda label, options, chosen=None: ("combobox", {"label": label, "options": options, "selected_option": chosen})
button = lambda label: ("button", {"label": label})
ROUTE = [box("From", ["Pune"], "Pune"), box("To", ["Goa"], "Goa"), box("Travel class", ["Sleeper"], "Sleeper"), box("Quota", ["General"], "General")]
PAGES = {
    "from": ([button("Search trains"), box("From", ["Delhi", "Pune"], "Delhi"), box("To", ["Goa"])], ("ROUTE", "SELECT", "el_1", None, "Pune", None)),
    "nowhere": ([button("Search trains"), box("From", ["Delhi"])], ("ROUTE", None, "el_1", None, None, "REQUEST_UNAVAILABLE: From")),
    "month": ([button("Search trains"), *ROUTE, box("Journey month", ["October 2026", "November 2026"], "October 2026"), button("Journey date 2026-11-07")], ("MONTH", "SELECT", "el_5", None, "November 2026", None)),
    "day": ([button("Search trains"), *ROUTE, box("Journey month", ["November 2026"], "November 2026"), button("Journey date 2026-11-06"), button("Journey date 2026-11-07")], ("DAY", "CLICK", "el_7", None, None, None)),
    "no day": ([button("Search trains"), box("Journey month", ["November 2026"], "November 2026")], ("DAY", None, None, None, None, "REQUEST_UNAVAILABLE: Journey date")),
    "dates": ([button("Search trains"), *ROUTE, button("Choose journey date")], ("OPEN_DATES", "CLICK", "el_5", None, None, None)),
    "search": ([button("Search trains"), *ROUTE, button("Selected journey date 2026-11-07")], ("BUTTON", "CLICK", "el_0", None, None, None)),
    "done": ([("heading", {"text": "Simulated booking complete"}), button("Pay simulated fare")], ("DONE", "FINISH", "el_0", None, None, None)),
    "private": ([("textbox", {"label": "Passenger email", "value_handle": "LOCAL_EMAIL_1"}), ("textbox", {"label": "Passenger name", "value_handle": "LOCAL_PERSON_NAME_1"})], ("PRIVATE", "TYPE_HANDLE", "el_1", "LOCAL_PERSON_NAME_1", None, None)),
    "age": ([("textbox", {"label": "Passenger name", "value_handle": "LOCAL_PERSON_NAME_1", "value_present": True}), box("Passenger age", ["30", "31"])], ("PASSENGER", "SELECT", "el_1", None, "30", None)),
    "fare": ([button("Choose train A, departure 08:10, fare 500"), button("Choose train B, departure 11:00, fare 90"), button("Choose train C, departure 12:00, fare 10")], ("FARE", "CLICK", "el_1", None, None, None)),
    "late": ([button("Choose train C, departure 12:00, fare 10"), button("Continue to payment"), button("Review journey")], ("BUTTON", "CLICK", "el_2", None, None, None)),
    "empty": ([button("Elsewhere")], None),
}


def test_journey_ladder(spark):
    rows = [el(s, i, role, **more) for s, (own, _) in PAGES.items() for i, (role, more) in enumerate(own)]
    rows += [el("planner", i, *own[:1], **own[1]) for i, own in enumerate(PAGES["fare"][0])] + [el("lost", 0, "button", label="Search trains")]
    trips = [(s, s != "planner", TRIP if s != "lost" else None) for s in (*PAGES, "planner", "lost")]
    kind = "snapshot_id string, rehearsal boolean, journey struct<" + ",".join(f"`{k}`:string" for k in TRIP) + ">"
    found = {r["snapshot_id"]: tuple(r)[1:] for r in ladders.journey(spark.createDataFrame(rows, ELEMENT), spark.createDataFrame(trips, kind)).collect()}
    for s, (_, want) in PAGES.items():
        assert found.get(s) == want, s
    assert found["planner"][:2] == ("FARE", None) and found["lost"] == ("ROUTE", None, None, None, None, "REQUEST_UNAVAILABLE: Booking request")
