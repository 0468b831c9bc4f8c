"""The scratch folder of a session."""

from lexstrata.session import shared_dir


class _Conf(dict):
    def set(self, key, value):
        assert key != "spark.checkpoint.dir", "not to be changed in a running session"
        self[key] = value


class _Session:
    def __init__(self, **named):
        self.conf = _Conf({"spark.master": "local[2]"} | named)


def test_a_folder_is_made_once_where_none_is_named():
    session = _Session()
    made = shared_dir(session)
    assert made and shared_dir(session) == made


def test_a_named_folder_is_taken():
    assert shared_dir(_Session(**{"spark.checkpoint.dir": "/shared/x"})) == "/shared/x"
