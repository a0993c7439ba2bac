"""What a worker keeps of the tokenizer library's answers."""

from types import SimpleNamespace

from fleetwise.llm import idfiles


def test_the_library_is_asked_in_parts():
    sizes = []

    class Library:
        def encode_batch_fast(self, words, add_special_tokens):
            sizes.append(len(words))
            return [SimpleNamespace(ids=[len(w)]) for w in words]

    words = ["x" * (k % 5) for k in range(2 * idfiles.ASKED + 3)]
    assert idfiles.ids_in_parts(Library(), words) == [[len(w)] for w in words]
    assert sizes == [idfiles.ASKED, idfiles.ASKED, 3] and idfiles.ids_in_parts(Library(), []) == []
