import pytest

from posmv.config import Config


def test_precedence(tmp_path):
    f = tmp_path / "app.properties"
    f.write_text("# note\na=file\nb = file \n")
    c = Config.load(["--config", str(f), "--b", "arg", "--flag", "--n", "7"], {"a": "platform", "c": "platform"})
    assert (c.get("a"), c.get("b"), c.get("c"), c.bool("flag"), c.int("n")) == ("file", "arg", "platform", True, 7)


def test_fallbacks_and_defaults():
    assert Config().int("mv.emit.interval.ms") == 1000
    assert Config({"mv.reval.interval.ms": "250"}).int("mv.emit.interval.ms") == 250
    assert Config({"mv.reval.interval.ms": "250", "mv.emit.interval.ms": "40"}).int("mv.emit.interval.ms") == 40
    assert Config({"emit.interval.ms": "20"}).int("position.emit.interval.ms") == 20
    assert Config({"mv.emit.interval.ms": "300"}).int("price.salt.conflate.ms") == 300
    assert Config().bool("dedup.enabled") and not Config().bool("positions.only")


def test_guarantee_is_checked():
    assert Config().guarantee() == "exactly-once"
    with pytest.raises(ValueError):
        Config({"sink.delivery.guarantee": "twice"}).guarantee()


def test_pass_through():
    assert Config({"kafka.props.security": "x", "other": "y"}).prefixed("kafka.props.") == {"security": "x"}


def test_arguments_need_dashes():
    with pytest.raises(ValueError):
        Config.load(["a"])
