import os
import signal

from tidewire.streaming.service import Service


def rows(spark):
    return spark.readStream.format("rate").option("rowsPerSecond", 5).load()


def test_stops_on_a_signal_and_beats(spark, tmp_path):
    start = lambda: rows(spark).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    beats = []

    def beat(failures):
        beats.append(failures)
        if len(beats) == 3:
            os.kill(os.getpid(), signal.SIGTERM)

    service = Service({"rate": start}, beat=beat, every=0.2)
    before = signal.getsignal(signal.SIGTERM)
    try:
        service.on_signal(signal.SIGTERM)
        assert service.run() == {"rate": 0}
    finally:
        signal.signal(signal.SIGTERM, before)
    assert len(beats) == 3 and all(b == {"rate": 0} for b in beats) and not spark.streams.active


def test_a_failing_stream_is_begun_again_and_given_up(spark, tmp_path):
    begun = []

    def start():
        begun.append(1)

        def fail(batch, number):
            raise RuntimeError("no")

        return rows(spark).writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "ck")).start()

    service = Service({"bad": start}, every=4.0, most=2)
    assert service.run() == {"bad": 2} and len(begun) == 2
