"""Rules on JavaScript and TypeScript, each on sources that it must and must not report."""

import pytest

from siftrock.operators import scripts

SOURCES = {
    "c.js": "try { a() } catch (e) { }\ntry { a() } catch { /* no */\n // none\n}\ntry { a() } catch (e) { console.error(e); }\ntry { a() } catch (e) { console.log(e); throw e; }\ntry { a() } catch (e) { if (x) { y() } }\n",
    "o.ts": "const x = r?.json()\nconst y = r.json()\n",
    "p.ts": "fetch('/a')\nawait fetch('/a')\nfetch('/a').catch(f)\nconst p = fetch('/a')\n// fetch('/a')\n\n\nPromise.all(xs)\n\n\n\ntry {\n  x = await Promise.race(xs)\n} catch (e) { no(e) }\n",
    "a.test.js": "expect(true).toBe(true)\nexpect(1).toEqual(2)\nexpect('a').toBeTruthy()\nexpect(x).toBe(true)\n",
    "a.js": "expect(true).toBe(true)\n",
    "f.js": "fs.readFileSync('a.txt')\nreadFile('a.csv', f)\nreadFile('a.txt', f)\n",
    "empty.js": "",
    "none.js": None,
    "other.py": "fetch('/a')\n",
}
EXPECTED = {
    "c.js": [(1, "CATCH_EMPTY"), (2, "CATCH_EMPTY"), (5, "CATCH_CONSOLE_ONLY")],
    "o.ts": [(1, "OPTIONAL_CHAIN_FALLIBLE")],
    "p.ts": [(1, "FLOATING_PROMISE"), (8, "FLOATING_PROMISE"), (8, "PROMISE_NO_CATCH")],
    "a.test.js": [(1, "JS_EXPECT_TRUE"), (3, "JS_EXPECT_TRUTHY")],
    "f.js": [(1, "JS_SYNC_FILE_READ"), (2, "JS_LARGE_FILE_SYNC_READ")],
}


@pytest.fixture(scope="module")
def found(spark):
    got = {}
    for r in scripts.all_scripts(spark.createDataFrame(list(SOURCES.items()), "path string, content string")).collect():
        got.setdefault(r.path, []).append((r.line, r.code))
    return {k: sorted(v) for k, v in got.items()}


def test_rules(found):
    assert found == EXPECTED
