import pytest

from delve.plans.tools import Tools

SERVICE = """class UserService(Base):
    \"\"\"Finds people.\"\"\"

    @cached_lookup
    def get(self, identifier: int) -> Person:
        return None


@router.get("/users/login")
def login():
    return "first message", "second message", " ", "\\ud800"
"""


@pytest.fixture(scope="module")
def tools(spark):
    return Tools(spark.createDataFrame([("app/auth_service.py", SERVICE.encode()), ("app/broken.py", b"def (")], "path string, content binary"))


def test_strings_are_searched(tools):
    r = tools.invoke("search_code", query="users login", kind="string")
    assert r.ok and (r.data[0]["kind"], r.data[0]["snippet"], r.data[0]["line"]) == ("string", "/users/login", 9)
    assert [(d["snippet"], d["line"]) for d in tools.invoke("search_code", query="message", kind="string").data] == [("first message", 11), ("second message", 11)]
    assert tools.invoke("search_code", query="x", kind="other").error["code"] == "unsupported_kind"


@pytest.mark.parametrize(("query", "symbol"), [("identifier", "UserService.get"), ("Person", "UserService.get"), ("cached lookup", "UserService.get"), ("Base", "UserService"), ("people", "UserService")])
def test_symbols_are_found_by_signature_decorators_bases_and_doc(tools, query, symbol):
    assert tools.invoke("search_code", query=query, kind="symbol").data[0]["symbol"] == f"app/auth_service.py::{symbol}"


def test_documents_are_the_references(tools):
    assert sorted(r.kind for r in tools.documents().collect()) == ["file"] * 2 + ["string"] * 5 + ["symbol"] * 3
