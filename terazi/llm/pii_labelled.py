"""The small labelled table from which the personal-information model is trained.

Each line is a sentence pattern; a part in square brackets is an item of the kind it names, the rest is ordinary text, and
braces are filled from the lists below. All persons, firms, places and numbers are invented.
"""

from __future__ import annotations

import random
import re

#: sentences with personal information, and such as must not be taken for it (fixed values)
PATTERNS = """
Duruşmada dinlenen tanık [name:{person}] {claim} beyan etmiştir.
Tanık [name:{person}] beyanında {claim} söylemiştir.
Keşifte dinlenen davalı tanığı [name:{person}] {claim} anlatmıştır.
Sanık [name:{person}] ile müşteki [name:{person}] arasında {place} önünde tartışma çıkmıştır.
Sanık [name:{person}], {place} önünde müşteki [name:{person}] ile karşılaşmıştır.
Muris [name:{person}]'in mirasçıları [name:{person}] ve [name:{person}] davaya katılmıştır.
Muris [name:{person}]'ın mirasçıları [name:{person}], [name:{person}] ve [name:{person}] davaya katılmıştır.
{exhibit} üzerindeki imza ne [name:{person}] ne de [name:{person}] tarafından atılmıştır.
{exhibit} altındaki imza [name:{person}] tarafından atılmamıştır.
[name:{person}] adına kayıtlı aracın {when} satıldığı belirlenmiştir.
[name:{person}] adına kayıtlı taşınmaz {when} devredilmiştir.
Bilirkişi olarak {title} [name:{person}] atanmıştır.
Bilirkişi {title} [name:{person}] raporunu sunmuştur.
{party} vekili Av. [name:{person}] {date} tarihli dilekçesini sunmuştur.
{party} vekili Avukat [name:{person}] {date} günü duruşmaya katılmıştır.
Başkan [name:{person}] Üye [name:{person}] Üye [name:{person}] Katip [name:{person}]
Başkan: [name:{person}] - Üye: [name:{person}] - Üye [name:{person}] - Katip: [name:{person}]
Başkan [name:{person}], Üye [name:{person}], Üye: [name:{person}], Üye [name:{person}], Raportör [name:{person}]
Başkanvekili [name:{person}]  Üye [name:{person}]  Raportör: [name:{person}]
Başkanvekili: [name:{person}] Üye [name:{person}] Raportör [name:{person}]
Hâkim [name:{person}] Katip: [name:{person}]
Hâkim: [name:{person}], Katip [name:{person}]
Hâkim: [name:{person}] - Zabıt Katibi [name:{person}]
Cumhuriyet Savcısı [name:{person}] mütalaasını bildirmiştir.
DAVACI : [name:{person}] VEKİLİ : Av. [name:{person}] - [address:{address}]. {sentence}
DAVACI : [name:{person}] VEKİLİ : Av. [name:{person}]
DAVALI : [name:{person}] VEKİLİ : Av. [name:{person}] - [address:{address}]
Sunulan deliller arasında {exhibit} vs. DAVACI : [name:{person}] VEKİLİ : Av. [name:{person}] - [address:{address}].
{party} [name:{person}] ([phone:{phone}], [address:{address}]) {date} günü dinlenmiştir.
{party} [name:{person}] (tel: [phone:{phone}], e-posta: [email:{email}]) {date} günü dinlenmiştir.
Tanık, "[name:{person}] bana [phone:{phone}] numarasından ulaştı, sonra [email:{email}] üzerinden yazdı." demiştir.
Tanık, "[name:{person}] beni [phone:{phone}] numaralı hattan aradı." demiştir.
Vekilin iletişim bilgileri (tel: [phone:{phone}], e-posta: [email:{email}]) tutanağa geçirilmiştir.
Vekilin telefonu [phone:{phone}], elektronik postası [email:{email}] olarak kayıtlıdır.
Davacıya [phone:{phone}] numaralı telefondan ulaşılmıştır.
Sanığa [phone:{phone}] numaralı hattan ulaşılamamıştır.
Cep telefonu: [phone:{phone}]
Faks [phone:{phone}] numarasına gönderilmiştir.
Bildirimin [email:{email}] adresine gönderildiği görülmüştür.
Katılma talebi <[email:{email}]> kutusundan gelmiş, T.C. kimlik numarası [identity:{id}] olan başvurana yanıt verilmiştir.
Katılma talebi <[email:{email}]> kutusundan gelmiş, [identity:{passport}] numaralı pasaport hamili başvurana yanıt verilmiştir.
Katılma talebi <[email:{email}]> kutusundan gelmiş, kimlik no [identity:{spaced}] olan başvurana yanıt verilmiştir.
Katılma talebi [email:{email}] kutusundan gelmiş, (TCKN: [identity:{id}]) başvurana yanıt verilmiştir.
T.C. kimlik numarası [identity:{id}] olan kişi hakkında {exhibit} düzenlenmiştir.
T.C. kimlik no: [identity:{id}] olan kişi hakkında {exhibit} düzenlenmiştir.
[identity:{id}] T.C. kimlik numaralı kişi hakkında {exhibit} düzenlenmiştir.
[identity:{passport}] numaralı pasaport hamili kişi hakkında {exhibit} düzenlenmiştir.
Pasaport no [identity:{passport}] olan kişi hakkında {exhibit} düzenlenmiştir.
Kimlik no [identity:{spaced}] olan kişi hakkında {exhibit} düzenlenmiştir.
T.C. No:[identity:{id}] sayılı kimliğin sahibi kişi hakkında {exhibit} düzenlenmiştir.
(TCKN: [identity:{id}]) kişi hakkında {exhibit} düzenlenmiştir.
Nüfus kaydında T.C. kimlik numarası [identity:{id}] olan [name:{person}] görünmektedir.
Nüfus kaydında [identity:{id}] T.C. kimlik numaralı [name:{person}] görünmektedir.
Nüfus kaydında kimlik no [identity:{spaced}] olan [name:{person}] görünmektedir.
Nüfus kaydında [identity:{passport}] numaralı pasaport hamili [name:{person}] görünmektedir.
Nüfus kaydında T.C. No:[identity:{id}] sayılı kimliğin sahibi [name:{person}] görünmektedir.
Nüfus kaydında (TCKN: [identity:{id}]) [name:{person}] görünmektedir.
Bilinen son adres: [address:{address}]; tebligat iade edilmiştir.
{party} tebligat adresini [address:{address}] olarak bildirmiştir.
Yerleşim yeri [address:{address}] olan davacı gelmemiştir.
{party} {firm} vekili, {exhibit} üzerindeki kaydın soyut olduğunu belirtmiştir.
{firm} ile {firm} arasındaki cari hesap {date} günü kesilmiştir.
Davacı şirketin unvanı {firm} olarak tescil edilmiştir.
Taşıma işini üstlenen şirket: {firm}
Taşıma işini üstlenen şirket: {firm} {sentence}
{party} vekili, {date} tarihli dilekçesinde {claim} ileri sürerek {topic} isteminde bulunmuştur.
{party} {masked} ile davalı ... arasında düzenlenen {exhibit} {date} tarihlidir.
Başvurucu {masked} hakkında {date} günü saat 16.03'te tutanak tutulmuştur.
Davacı ... vekili, {masked} adına {exhibit} sunmuştur. Davalı ----- vekili, *** adına {exhibit} sunmuştur.
{city} {n}. Asliye Hukuk Mahkemesi, {case} esas sayılı dosyada davanın kabulüne karar vermiştir.
{city} {n}. Asliye Ticaret Mahkemesi kararının temyizi üzerine {case} E., {case} K. sayılı dosya incelendi; {exhibit} okundu.
{city} Bölge Adliye Mahkemesi {n}. Hukuk Dairesi, {case} E. sayılı karar.
Bkz. aynı yönde {city} {n}. İdare Mahkemesi, {case} E. sayılı karar.
Danıştay {n}. Dairesinin {date} tarih ve E.{case}, K.{case} sayılı kararı aynı yöndedir.
Yargıtay {n}. H.D.nin {case} E., {case} K. sayılı ilamı.
HÜKÜM: Yukarıda açıklanan nedenlerle {city} {n}. Asliye Ticaret Mahkemesi kararı yönünden {topic} talebinde hükmün onanmasına, {money} TL harcın davalı üzerinde bırakılmasına, {date} tarihinde oybirliğiyle karar verildi.
SONUÇ: {claim2} nedeniyle {topic} davasında itirazın kısmen iptaline, {money} TL vekâlet ücretinin davacı tarafından ödenmesine {date} gününde oyçokluğuyla karar verildi.
Açıklanan gerekçelerle {topic} isteminin REDDİNE, davanın kabulüne ve dosyanın {city} {n}. Asliye Hukuk Mahkemesi esasına gönderilmesine kesin olarak karar verildi.
İşlem, {city} Büyükşehir Belediyesinin {date} tarihli yazısı ve {n} sayfalık {exhibit} esas alınarak kurulmuştur.
{n4} sayılı Türk Medeni Kanunu'nun {n}. maddesi uyarınca {party} yönünden {claim2} bozma nedenidir.
{n4} sayılı Hukuk Muhakemeleri Kanunu'nun {n} ve {n}. maddeleri uyarınca {party} yönünden {claim2} bozma nedenidir.
T.C. {city} Valiliği işlemi {date} günü geri almıştır.
Karayolları XII. Bölge Müdürlüğü {date} günlü yazısıyla yanıt vermiştir.
{city} ilinde bulunan {place} hakkında {n} gün süreyle {exhibit} tutulduğu tartışmasızdır.
Kaza, {street} Caddesi ile {street} Sokağın kesiştiği kavşakta meydana gelmiştir.
Taşınmaz {street} Mahallesi {n3} ada {n} parselde kayıtlıdır.
Dava konusu taşınmaz {street} Mah. {n3} ada {n} parsel no. ile kayıtlıdır.
Evrakın barkod numarası {n11} olarak işlenmiştir.
EVRAK TAKİP NUMARASI: {n4}-{n6}
{n11} numaralı elektrik aboneliğine ait {exhibit} istenmiştir.
{n11} numaralı su sayacına ait {exhibit} istenmiştir.
Araç {n} BJ {n3} plakalıdır ve şasi numarası A{n6}8 olarak görünmektedir.
Toplam {n} kişinin çalıştığı {place} için {money} TL idari para cezası kesilmiştir.
Alacağın {money}-TL kısmı için takip {when} başlatılmış ve {party} süresinde itiraz etmiştir.
Endeks {n} endeksini göstermiş, bedel {money} TL @ birim olarak yazılmıştır.
Başvuru, {topic} kapsamında {claim2} iddiasına ilişkindir (B. No: {case}, {date}).
İtiraz yoluna başvuran {city} {n}. Asliye Hukuk Mahkemesi, {n4} sayılı İcra ve İflas Kanunu'nun {n} ve {n}. maddeleri hükmünün eşitlik ilkesi yönünden iptalini istemiştir (E.{case}, K.{case}).
Prof. Dr. unvanlı bilirkişi, {exhibit} için "Bu kayıt isabetsiz. Başka bir belgeye gerek yok." şeklinde görüş bildirmiştir.
Av. sıfatıyla duruşmaya katılan vekil, md. {n3}/f. 1 hükmüne dayanmıştır.
Ör. {exhibit} için saat 15.47'da keşfe çıkılmış, Dz. Kuv. K.lığı yazısı da okunmuştur.
Davacı vekili tebligat parçasını {date} gününde dosyaya sunmuştur. Davacı vekili bu tutara neden itiraz etmemiştir?
Dosya arasındaki {exhibit} ile {exhibit} birlikte incelendiğinde, {money} TL tutarındaki bedelin {when} ödenmediği anlaşılmıştır.
Sayın hâkim, bu {exhibit} sahtedir! Peki, {exhibit} olmaksızın {topic} istenebilir mi?
Sayaç {n} {n3} {n2} {n2} endeksini göstermiş, bedel {money} TL @ birim olarak yazılmıştır.
Sayaç {n} {n3} {n2} {n2} endeksini göstermiştir.
Araç {n} KC {n3} plakalıdır ve şasi numarası {passport} olarak görünmektedir.
Araç {n} AB {n3} plakalıdır ve motor numarası {letter}{n6}1 olarak görünmektedir.
Doğrulama kodu {code} olan çıktı eklenmiştir.
Evrak {code} koduyla doğrulanabilir.
{n3} sayılı Vergi Usul Kanunu'nun {n} ve {n}. maddeleri uyarınca {party} yönünden {claim2} bozma nedenidir.
{n4} sayılı Türk Borçlar Kanunu'nun {n}. maddesi uyarınca {party} yönünden {claim2} bozma nedenidir.
{n4} sayılı İdari Yargılama Usulü Kanunu'nun {n}. maddesi uyarınca karar verilmiştir.
{n4} sayılı Türk Ceza Kanunu'nun {n}. maddesi uyarınca ceza verilmiştir.
{n4} sayılı Türk Ticaret Kanunu'nun {n}. maddesi uygulanmıştır.
{party} {firm} vekili, {date} tarihli {exhibit} ile {claim} belirtmiştir.
{party} {firm} temsilcisi dinlenmiştir.
Üye hâkimlerden biri, {claim2} konusunda çoğunluğa katılmamış; {place} yönünden ayrı görüş yazmıştır.
Üye hâkim çoğunluğa katılmamıştır. Davalı tanığı dinlenmemiş, tanık beyanı yetersiz bulunmuştur.
""".strip().splitlines()
#: everyday sentences beyond court decisions: letters, minutes, notices, forms, news; and such without any item (fixed values)
GENERAL = """
Toplantıda [name:{cased}] söz aldı.
Toplantıya [name:{cased}] ile [name:{cased}] katılamadı.
Dün akşam [name:{cased}] ile görüştüm.
Dün [name:{cased}] aradı, yarın gelecekmiş.
Bugün [name:{cased}] görevine başladı.
Yarın [name:{single}] hanım gelecek.
Geçen hafta [name:{single}] Bey bize uğradı.
Sayın [name:{cased}], talebiniz alınmıştır.
Sevgili [name:{single}], mektubun bugün ulaştı.
Merhaba [name:{single}], raporu ekte gönderiyorum.
Saygılarımla, [name:{cased}]
Hazırlayan: [name:{cased}]
Onaylayan: [name:{cased}], {date}
Adı Soyadı: [name:{cased}]
Ad Soyad : [name:{cased}] Telefon: [phone:{phone}]
Yetkili kişi [name:{cased}] olup telefonu [phone:{phone}] numarasıdır.
Komşumuz [name:{cased}] anahtarı bırakmış.
Öğretmenimiz [name:{cased}] ödevleri topladı.
Doktorum [name:{cased}] ilacı değiştirdi.
Yazar [name:{cased}] yeni kitabını tanıttı.
Oyuncu [name:{cased}] ödülü aldı, yönetmen [name:{cased}] teşekkür etti.
Kazada yaralanan [name:{cased}] hastaneye kaldırıldı.
Konuşmacılar arasında [name:{cased}], [name:{cased}] ve [name:{cased}] vardı.
Projeyi [name:{cased}] yürütüyor.
Ekibimize [name:{cased}] katıldı.
Belgeyi [name:{cased}] adına düzenleyin.
Evi [name:{cased}]'dan kiraladık.
Arabayı [name:{cased}]'ya sattım, parasını [name:{cased}]'den aldım.
Babam [name:{cased}], annem [name:{cased}].
Müdürümüz [name:{cased}] izne ayrıldı.
Başkan Yardımcısı [name:{cased}] toplantıyı açtı.
Kardeşim [name:{single}] okula başladı.
Ofisimiz [address:{address}] adresindedir.
Yeni yerimiz [address:{address}] oldu.
Mağazamız [address:{address}] adresine taşındı.
Teslimat adresi: [address:{address}]
Fatura adresi [address:{address}]
Kargo şubesi [address:{address}] üzerindedir.
Adres: [address:{address}] Tel: [phone:{phone}]
Kargoyu [address:{address}] adresine yollayın.
Düğünümüz [address:{address}] adresindeki salonda olacak.
Bizi [phone:{phone}] numarasından arayın.
Bizi [phone:{short}] numarasından arayabilirsiniz.
Randevu için [phone:{short}] numarasını arayın.
Telefon: [phone:{short}]
Telefon: [phone:{phone}]
Tel [phone:{short}], faks [phone:{short}]
GSM: [phone:{phone}]
Müşteri hattı [phone:{short}] her gün açıktır.
WhatsApp hattımız [phone:{phone}] olarak değişti.
Yurt dışından [phone:{abroad}] numarası aranmalıdır.
Call us at [phone:{abroad}] for details.
Phone: [phone:{abroad}], e-mail: [email:{email}]
You can reach [name:{english}] at [phone:{abroad}].
Sorularınızı [email:{email}] adresine yazın.
E-posta: [email:{email}]
Bilgi için [email:{email}] veya [phone:{phone}].
İletişim: [name:{cased}], [email:{email}], [phone:{phone}]
kimlik: [identity:{parted}]
Kimlik numarası: [identity:{parted}]
TC: [identity:{id}]
T.C. Kimlik No : [identity:{id}] Adı Soyadı : [name:{cased}]
Pasaport: [identity:{passport}]
Passport no. [identity:{passport}] belongs to [name:{english}].
[name:{english}] and [name:{english}] came.
[name:{english}] and [name:{english}] signed the agreement yesterday.
The report was written by [name:{english}].
Mr. [name:{english}] met Mrs. [name:{english}] in London.
Dear [name:{english}], thank you for your letter.
Our manager [name:{english}] will call you.
Witness [name:{english}] denied it.
Herr [name:{english}] wohnt in Berlin.
Madame [name:{english}] a signé le contrat.
According to [name:{english}], prices rose in March.
Toplantı saat 14.30'da başladı ve kimse söz almadı.
Yarın hava güneşli olacak, Cuma günü yağmur bekleniyor.
Bugün Kızılay Meydanı trafiğe kapatıldı.
Kadıköy Belediyesi yeni parkı Pazartesi açıyor.
Ege Üniversitesi Rektörlüğü açıklama yaptı.
Türkiye Büyük Millet Meclisi Genel Kurulu toplandı.
Ankara Gar binası onarılacak, Haydarpaşa Gar açık kalacak.
Dün Fenerbahçe maçı {n}-{n} bitti.
Kuzey Ege kıyılarında Ağustos ayı serin geçti.
Ürün kodu {n6}, seri no {letter}{n6}, stok {n4} adet.
Sipariş numarası {n6}-{n4} ile takip edilebilir.
Fiş no {n11}, kasa {n}, tutar {money} TL.
Hesap no {n4}-{n6}-{n} üzerinden ödeme yapılmıştır.
IBAN TR{n2} {n4} {n4} {n4} {n4} {n4} {n2} hesabına yatırın.
Uçuş TK{n4} saat 09.45'te kalkar, kapı {n}.
Seri {n3}-{n3}-{n2} parça {n} depoda.
{firm} genel kurulu {date} günü toplandı.
{street} Caddesi ile {street} Sokağı arasında çalışma var.
Siyah Kalem adlı roman ile Beyaz Gemi filmi gösterildi.
The National Bank of Scotland opened a branch in New York City.
On Monday the Supreme Court heard the case of the Northern Railway Company.
United Nations Security Council met in Geneva on {date}.
Die Stadt Frankfurt am Main plant eine Neue Brücke.
Nüfus {n3}.{n3}, yüzölçümü {n4} km2, rakım {n3} m.
Ölçüler {n3}x{n3}x{n2} cm, ağırlık {n2},{n} kg.
Koordinatlar {n2}.{n6}, {n2}.{n6} noktasıdır.
Sürüm {n}.{n}.{n} yayımlandı, derleme {n4}{n4}.
Maddeler {n}, {n}, {n} ve {n} yürürlükten kalktı.
{word} [name:{cased}] {word} {word}.
{word} {word} [name:{cased}] {word}.
{word} {word} {word} [name:{cased}] ve [name:{cased}] {word}.
{word} [name:{cased}] tarafından {word} {word}.
{word} {word} [name:{cased}]'a {title2} {word}.
{title2} [name:{cased}] {word} {word} {word}.
The {word} from [name:{english}] {word} late.
Professor [name:{english}] {word} a {word}.
{word} [address:{address}] adresindedir.
{word} {word} [address:{address}] {word} {word}.
{word} numara [identity:{parted}] olarak {word}.
{word} numaram [identity:{id}], {word} {word}.
{word} {word} {word} {word} {word} {word}.
{word} {word} {word}, {word} {word} {word} {word} ve {word} {word}.
{word} {word} ile {word} {word} arasında {word} {word} {word}.
{inst} {word} {word} {word}.
{word} {inst} {word} {word}, {word} {inst} {word}.
{inst} ile {inst} {word} {word}.
{word} {n6}{n4} {word}, {word} {n4} {word}.
{word} {word} {day} günü {inst} binasında {word}.
{word} {day} {word} {month} ayında {word}.
The {inst2} {word} its {word} in {enmonth}.
Ne var ki {exhibit} {word} ve {exhibit} {word} {word}.
Ne var ki {word} {word} {word}.
Kaldı ki {word} {word}, oysa {word} {word} değildir.
{party} {masked} ile {masked} {word} {word}.
{party} {masked} {word} {word}.
Takip numarası {n11} olan {word} {word}.
""".strip().splitlines()
#: page furniture without any person, given as it is, in capitals, in small letters and without accents (fixed values)
FURNITURE = """
Yayına hazırlayan: İçtihat Derleme Birimi
Bu evrak güvenli elektronik imza ile imzalanmış olup aslı sistemde saklanmaktadır.
Bu karar yalnızca bilgilendirme amacıyla yayımlanmıştır, resmî nüsha yerine geçmez.
Resmî yayın dışında kalan bu metin yorumda esas alınamaz.
İstinaf ve temyiz süreleri için tebliğ tarihini esas alınız.
Metindeki gizlenmiş alanlar üç nokta ile gösterilmiştir.
Kişisel veriler, ilgili mevzuat gereğince karartılmıştır.
Emsal arama sonuçlarına geri dönmek için tıklayınız
Önceki karar | Sonraki karar
Kararı paylaş: E-posta | Kısa mesaj | Bağlantıyı kopyala
Kısa bağlantı oluştur / Arkadaşına gönder
Basın duyurusu için kurumsal iletişim birimine başvurunuz.
İngilizce özet hazırlanmaktadır, daha sonra eklenecektir.
Katkıda bulunan: Karar Tarama Ekibi (vardiya {n})
Kararlar bilgi bankası – kayıt {n4}
İdari yargı bülteni, cilt {n}, sayı {n}
Norm denetimi dizini, sıra no {n3}
Dipnotları göster veya gizle
Bu sayfa {n}.{n3} kez görüntülendi
Son güncelleme {n}.{n}.{n4} saat {n}:{n}
İçtihat arşivi sayfa {n} / {n}
İlginizi çekebilecek diğer ilamlar
© Karar İzleme Servisi {n4}, izinsiz çoğaltılamaz
Evrak takip numarası: {n4}-{n6}
Yazdır - Kaydet - Görüş bildir
""".strip().splitlines()

LISTS = {
    "given": "Ahmet Mehmet Mustafa Ali Hüseyin Hasan İbrahim İsmail Osman Yusuf Murat Ömer Ramazan Halil Süleyman Fatma Ayşe Emine Hatice Zeynep Elif Meryem Şerife Zehra Sultan Hanife Merve Havva Zeliha Esra Özge Gamze Tuğba Burcu Sibel Selin Deniz Ece Cem Can Kaan Emre Burak Onur Volkan Serkan Hakan Gökhan Barış Bülent Erol Metin Nihat Orhan Levent Kerem Koray Tolga Umut Serhat Sarp Faruk Cemil Hikmet Rıza Ertan Çağrı İlker İpek Şule Aslı Ayça Bahar Derya Gizem Güneş Işıl Melike Nazlı Nehir Pelin Sevgi Tülin Yonca Zuhal Özlem Ülkü".split(),
    "stem": "kaya demir yıldız çelik aydın öz arslan doğan kılıç kur ak kara bay tek gök yeşil boz güler er alp sön taş bal sel dağ tun tepe uç yur mor".split(),
    "end": "oğlu er türk can soy maz gil kan baş ten lar lı sız bek mez han su yol kaç dal".split(),
    "foreign": "Pieter van Oosten|Lars Holmqvist|Reza Karimzad|Tran Duc Minh|Maria da Costa Pinho|Jan de Vries|Karl von Stetten|Ivan Petrovski|John Whitcombe|Amira bin Saleh|Olena Kravets|Agnieszka Borowska|Ion Munteanu|Levan Beridze".split("|"),
    "english_given": "John Jane Mary Peter Susan David Emily George Alice Robert Helen Thomas Anna Michael Laura Paul Claire Stephen Julia Martin Sophie Daniel Rachel Hans Klaus Ingrid Pierre Jean Marie Luc Carla Marco Giulia Pablo Elena".split(),
    "english_stem": "Ash Black Brook Cliff Down East Fair Green Hart Kings Lang Mill North Oak Red Stan Thorn Under Wal Win".split(),
    "english_end": "by croft field ford ham ley man son ton well wood worth".split(),
    "english_lead": "O'|Mc|Mac|De|".split("|"),
    "ending": "ı i u ü nı ni da de dan den lar ler ları leri ya ye ın in lık li sız yor dı di mış miş acak ecek ması mesi larda lerden".split(),
    "inst_end": "Belediyesi Üniversitesi Örgütü Köprüsü Denizi Bankası Kurumu Müdürlüğü Hastanesi Lisesi Derneği Vakfı Meydanı Kampüs Stadı Kulübü Gazetesi Bakanlığı Boğazı Ovası Dağı Adası Cumhuriyeti Birliği Odası Kurulu Başkanı".split(),
    "inst2": "Bank of|Republic of|University of|City of|Kingdom of|Isle of".split("|"),
    "enmonth": "January February March April May June July August September October November December".split(),
    "day": "Pazartesi Salı Çarşamba Perşembe Cuma Cumartesi Pazar".split(),
    "title2": "Öğretmen|Müdür|Komutan|Kaptan|Yönetmen|Sanatçı|Muhtar|Belediye Başkanı|Avukatım|Komşum".split("|"),
    "party": "Davacı|Davalı|Davacı vekili|Davalı vekili|Müdahil|Borçlu|Alacaklı|İhbar olunan|Temyiz eden|Başvurucu".split("|"),
    "title": "mali müşavir|mühendis|Dr.|Prof. Dr.|Doç. Dr.|doktor|mimar|Uzm. Dr.".split("|"),
    "exhibit": "kira kontratı|fatura|tapu kaydı|ödeme emri|tanık beyanı|kamera kaydı|bilirkişi raporu|sözleşme|tebligat parçası|nüfus kaydı|keşif tutanağı|banka dekontu|uydu fotoğrafı|vekâletname|ticari defter".split("|"),
    "place": "yayla evi|otopark|okul bahçesi|taş ocağı|kavşak|pazar yeri|trafo binası|sulama kanalı|apartman girişi".split("|"),
    "claim": "bedelin tamamının ödendiğini|imzanın kendisine ait olmadığını|rekabet yasağına uyulmadığını|malların eksik teslim edildiğini|ürünün bozuk çıktığını|olay günü şehir dışında bulunduğunu|aracın bakımının yapılmadığını".split("|"),
    "claim2": "savunma hakkının kısıtlanması|Ek rapor alınmaması|harcın eksik tamamlanması|Yasal indirimin uygulanmaması|Tanıkların dinlenmemesi".split("|"),
    "topic": "tapu iptali ve tescil|Kira alacağı|menfi tespit|Özel hayata saygı hakkı|dolandırıcılık|Marka hükümsüzlüğü".split("|"),
    "when": "olay tarihinde|ihale aşamasında|keşif sırasında|tebliğden önce|ilk celsede|yargılama sürerken|ölümden sonra".split("|"),
    "sentence": "Rapora yapılan itirazın karşılanmaması bozma nedenidir.|Bilirkişi heyeti bir değer hesaplamıştır.|İlk derece mahkemesince taraf teşkili sağlanmamıştır.".split("|"),
    "street": "Gül Lale Papatya Menekşe Nergis Defne Söğüt Çınar Kestane Ihlamur Kardelen Değirmen Bahçe Işık Ürün Barış Hürriyet İstiklal Fener Çamlıca Ortabağ Yenidoğan Güneşli Zeytinlik Köprübaşı Şirinyer".split(),
    "town": "Çınarlı Aktepe Kavaklı Yeşilova Taşköprü Dereköy Bağdere İncesu Üçkuyu Örenbaşı Gölyazı Karapınar".split(),
    "city": "Ankara İzmir Bursa Adana Konya Samsun Denizli Kayseri Mersin Trabzon Erzurum Malatya Sakarya Kocaeli Manisa Muğla Antalya Çorum Tekirdağ".split(),
    "firm1": "Nardan Belsu Özbent Korveş Havtek Anatur Demsa Mavişen Gürçelik Ferova Sarvan Ilgaztur Yolaç Aksan".split(),
    "firm2": "Tekstil İnşaat Otomotiv Turizm Gıda Lojistik Enerji Madencilik Kimya Sigorta".split(),
    "firm3": "A.Ş.|Ltd. Şti.|San. ve Tic. A.Ş.|Tic. Ltd. Şti.|San. ve Tic. Ltd. Şti.".split("|"),
    "month": "Ocak Şubat Mart Nisan Mayıs Haziran Temmuz Ağustos Eylül Ekim Kasım Aralık".split(),
    "host": "mail.ornek.example posta.example baro-uye.example hukukburo.example avukat.invalid sirket.test".split(),
}
FOREIGN_STREETS = "Hauptstrasse|Bahnhofstrasse|Kirchgasse|Buchenweg|Rosenweg|Rue du Moulin|Rue des Lilas|Avenue de la Gare|Via Garibaldi|Calle Mayor|Eschenstrasse|Mühlgasse".split("|")
FOREIGN_TOWNS = "Altdorf Neustadt Bellerive Montclair Rosental Grünau".split()
_UP = str.maketrans("iı", "İI")
_PLAIN = str.maketrans("çğıöşüİ", "cgiosui")


class _Filler:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return str(self.r.randint(1, 9)) + "".join(str(self.r.randint(0, 9)) for _ in range(n - 1))

    def pick(self, name: str) -> str:
        return self.r.choice(LISTS[name])

    def surname(self) -> str:
        return (self.pick("stem") + self.pick("end")).translate(str.maketrans("", "", "'"))

    def person(self) -> str:
        r = self.r
        if r.random() < 0.06:
            return self.pick("foreign")
        given = self.pick("given")
        if r.random() < 0.15:
            given += " " + self.pick("given")
        if r.random() < 0.12:
            given = r.choice("ABCÇDEFGHIİKLMNOÖPRSŞTUÜYZ") + ". " + (given if r.random() < 0.4 else "")
        last = self.surname()
        title = last[0].translate(_UP).upper() + last[1:]
        last = last.translate(_UP).upper() if r.random() < 0.65 else title
        if r.random() < 0.1:
            other = self.surname().translate(_UP).upper()
            last += " " + other
        name = " ".join(given.split()) + (" " if r.random() < 0.93 else "  ") + last
        u = r.random()
        return name.translate(_UP).upper() if u < 0.09 else name.replace("I", "ı").replace("İ", "i").lower() if u < 0.15 else name

    def word(self) -> str:
        """A made-up word with a Turkish ending."""
        r = self.r
        parts = (r.choice(["", *"bcçdfghklmnprsştvyz"]) + r.choice("aeıioöuü") + r.choice(["", "", *"klmnrsşty"]) for _ in range(r.randint(1, 3)))
        return "".join(parts) + r.choice(["", self.pick("ending"), self.pick("ending")])

    def inst(self) -> str:
        names = [w[0].translate(_UP).upper() + w[1:] for w in (self.word() for _ in range(self.r.choice([1, 1, 2])))]
        return " ".join([*names, self.pick("inst_end")])

    def english(self) -> str:
        r = self.r
        last = self.pick("english_stem") + self.pick("english_end")
        last = (r.choice(LISTS["english_lead"]) if r.random() < 0.2 else "") + last
        middle = r.choice(["", "", "", f"{r.choice('ABCDEFGHJKLMNPRST')}. ", self.pick("english_given") + " "])
        return f"{self.pick('english_given')} {middle}{last.upper() if r.random() < 0.1 else last}"

    def short(self) -> str:
        """A local or service number."""
        b, c, d, e = (self.digits(n) for n in (3, 2, 2, 4))
        return self.r.choice([f"{b} {c} {d}", f"{b}-{c}-{d}", f"{b} {e}", f"{b}{e}", f"444 {self.r.randint(0, 9)} {b}", f"444 {c} {d}", f"444{e}", f"0850 {b} {c} {d}"])

    def abroad(self) -> str:
        b, c, d, e = (self.digits(n) for n in (3, 2, 7, 4))
        return self.r.choice([f"+{c} {b} {d}", f"+{c} {c} {e} {e}", f"00{c} {b} {e}{c}", f"+1 {b} {b} {e}", f"+1-{b}-{b}-{e}", f"+{c}{b}{d}", f"+{c} ({c}) {e}-{e}"])

    def phone(self) -> str:
        a, b, c, d, e = (self.digits(n) for n in (3, 3, 2, 2, 7))
        return self.r.choice([f"0 {a} {b} {c}{d}", f"0({a}) {b} {c} {d}", f"(0{a}) {b} {c} {d}", f"+90 {a} {b} {c} {d}", f"+90({a}){e}", f"+90.{a}.{b}.{c}.{d}", f"0090 {a} {e}", f"{a}-{b}-{c}-{d}", f"0{a} {b} {c} {d}", f"0{a}{e}", f"0 ({a}) {b} {c} {d}", f"0{a}/{b} {c} {d}"])

    def email(self) -> str:
        r, host = self.r, self.pick("host")
        who = self.pick("given").replace("I", "ı").lower().translate(_PLAIN) + r.choice(["", ".", "_", "-"]) + self.surname().translate(_PLAIN)
        who += r.choice(["", "", str(r.randint(1, 99)), "+dava"])
        at = r.choice(["@"] * 6 + [" @ ", "(at)", " [at] "])
        return (who + at + host).upper() if r.random() < 0.15 else who + at + host

    def address(self) -> str:
        s, t, c, n, m = self.pick("street"), self.pick("town"), self.pick("city"), self.r.randint(1, 190), self.r.randint(1, 40)
        q, r = self.pick("street"), self.r
        return r.choice([
            f"{q} Mah. {s} Sok. No: {n}/{m} {t}/{c}", f"{q} Mh. {n}. Sk. {m}/A {self.digits(5)} {t}/{c.translate(_UP).upper()}", f"{s} Sokak No.{n} D.{m} {t} - {c}",
            f"{q} Mahallesi, {s} Caddesi No:{n} Kat:{m} Daire:{m} {t} {c}", f"{s} Bulvarı {n}/{m}, {t}, {c}", f"{t} Köyü {s} Mevkii No: {n}, {c}",
            f"{q} Mah. {s} Cad. No:{n} D:{m} {t}/{c}", f"{t} Köyü No: {n} {c}", f"{s} Cad. No: {n} {t} {c}",
            *[f"{r.choice(FOREIGN_STREETS)} {n}, {self.digits(5)} {r.choice(FOREIGN_TOWNS)}"] * 2,
        ])

    def slot(self, name: str) -> str:
        r = self.r
        if name == "cased":
            while (value := self.person()) == value.lower():
                pass
            return value
        if name == "inst2":
            return f"{r.choice(['', 'Royal ', 'National '])}{self.pick('inst2')} {self.word().title()}"
        if name == "single":
            return self.pick("given")
        if name == "parted":
            a, b, c, d = (self.digits(n) for n in (3, 3, 3, 2))
            return r.choice([f"{a}-{b}-{c}-{d}", f"{a} {b} {c} {d}", f"{a}.{b}.{c}.{d}", f"{a}{b}{c}{d}"])
        if name in ("person", "phone", "email", "address", "english", "short", "abroad", "word", "inst"):
            return getattr(self, name)()
        if name == "firm":
            return f"{self.pick('firm1')} {self.pick('firm2')} {self.pick('firm3')}"
        if name == "masked":
            return r.choice(["...", "*" * r.randint(3, 5), *["".join(f"{r.choice('ABCÇDEFGHİKLMNOÖPRSŞTUÜVYZ')}." for _ in range(r.choice([2, 2, 3])))] * 6])
        if name == "date":
            d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(1995, 2024)
            return r.choice([f"{d:02}.{m:02}.{y}", f"{d}/{m}/{y}", f"{d} {self.pick('month')} {y}"])
        if name == "id":
            return self.digits(11)
        if name == "spaced":
            return f"{self.digits(3)} {self.digits(3)} {self.digits(3)} {self.digits(2)}"
        if name == "passport":
            return r.choice("UPQXYZST") + self.digits(2) + r.choice([" ", ""]) + self.digits(6)
        if name == "letter":
            return r.choice("ABCDEFGHJKLMNPRSTUVWXYZ")
        if name == "code":
            return "".join(r.choice("ABCDEFGHJKMNPRSTUVYZ23456789") for _ in range(r.randint(12, 34)))
        if name == "case":
            return f"{r.randint(1998, 2024)}/{r.randint(1, 40000)}"
        if name == "money":
            return r.choice([f"{r.randint(1, 999)}.{self.digits(3)}", f"{r.randint(1, 999)}.{self.digits(3)},{self.digits(2)}"])
        if name[0] == "n":
            return {"n": str(r.randint(1, 99)), "n2": self.digits(2), "n3": self.digits(3), "n4": self.digits(4), "n6": self.digits(6), "n11": self.digits(11)}[name]
        return self.pick(name)


def labelled_table(copies: int = 8, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) of each pattern filled copies times."""
    fill, out = _Filler(seed), []
    lines = [(p, copies * 2 if re.search("{(phone|address|firm)}", p) else copies) for p in PATTERNS] + [(p, copies) for p in GENERAL] + [(p, 4) for p in FURNITURE]
    for pattern, times in lines:
        for k in range(times):
            text, spans = "", []
            for part in re.split(r"(\[\w+:\{\w+\}\]|\{\w+\})", pattern):
                if part.startswith("[") and ":" in part:
                    kind, slot = part[1:-1].split(":")
                    value = fill.slot(slot[1:-1])
                    spans.append((len(text), len(text) + len(value), kind))
                    text += value
                elif part.startswith("{"):
                    value = fill.slot(part[1:-1])
                    text += value[0].translate(_UP).upper() + value[1:] if not text else value
                else:
                    text += part
            if pattern in FURNITURE:
                text = [text, text.translate(_UP).upper(), text.replace("I", "ı").replace("İ", "i").lower(), text.translate(_PLAIN)][k]
            out.append((text, spans))
    return out
