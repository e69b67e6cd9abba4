"""Published signatures of formats, as fixed values.

A line has a format's place in the order of detection, its name, the confidence where the line's
tests all hold, and the tests:
  offset:value/... one of some values at an offset (from the end, if negative), in hexadecimal or as 'text' with "_" for blanks
  .a|b             the file name's extension is one of these
  len=a|b          the blob's length is one of these; len<=n and len>=n bound it
"""

from __future__ import annotations

# Archives, compressed files, disk images and programs that hold other files
CONTAINERS = """
6 cfb 100 0:d0cf11e0a1b11ae1
7 applesd 100 0:00051600/00051607
8 gzip 100 0:1f8b08
10 cab 100 0:'MSCF'
11 hlp 100 0:3f5f0300
12 rpm 100 0:edabeedb
15 stuffit 100 0:'SIT!'/'StuffIt_('
29 exe 80 0:'MZ'
36 tar 90 257:'ustar'
37 zip 100 0:'PK' 2:0304/0506
45 mscompress 100 0:535a444488f02733/4b57414a88f027d1/535a2088f02733
46 is_ibt 90 0:'setup.dl_' 9:00 10:'setup.dll' 19:00
47 mrnz 100 0:'MRNZ' 4:88f02733
51 swg 90 2:'-sw0-'/'-sw1-'
51 swg 100 2:'-sw0-'/'-sw1-' .swg
52 atari_afx 87 2:'-afx-' 20:00
53 tpk 75 2:'-TK0-'/'-TK1-'
53 tpk 100 2:'-TK0-'/'-TK1-' .tpk
54 pakleo 100 0:'LEOLZW' 39:'-l'
55 arx 70 2:'-lh1-' 20:2000
55 arx 100 2:'-lh1-' 20:2000 .arx
56 zoo 100 20:dca7c4fd
58 zoo_z 80 0:fe0701
59 binhex 100 0:'(This_file_must_be_converted_with_BinHex'
68 ar 100 0:'!<arch>' 7:0a
69 cpio 100 0:'070707'/'070701'/'070702'
75 arcfs 100 0:'Archive' 7:00
82 rar 100 0:'Rar!' 4:1a0700/1a070100
82 rar 100 0:'RE~^'
83 tscomp 100 0:655d138c
89 is_z 100 0:135d658c
90 is_instarch 100 0:2aab79d80001
94 amiga_dms 85 0:'DMS!'
94 amiga_dms 100 0:'DMS!' 24:000dc000
96 woz 100 0:'WOZ' 4:ff0a0d0a
97 moof 100 0:'MOOF' 4:ff0a0d0a
107 sis 100 4:6d000010/123a0010 8:19040010
114 ascii85 100 0:'xbtoa_Begin'/'xbtoa5_'
114 ascii85 10 0:'<~'
115 binscii 90 0:'FiLeStArTfIlEsTaRt'
115 binscii 100 0:'FiLeStArTfIlEsTaRt' .bsc|bsq
117 hpi 100 0:894850490d0a1a0a
118 hta 100 0:894854410d0a1a0a
138 atr 60 0:9602
139 t64 80 0:'C64'
142 compress 100 0:1f9d
166 squeeze 70 0:76ff
166 squeeze 25 0:faff
167 crunch 70 0:76fe
168 crlzh 70 0:76fd
169 zsq 90 0:'WACK'
171 edi_pack 100 0:'EDILZSS1'/'EDILZSS2'
175 mdcd 91 0:'MDmd'
176 cazip 100 0:0d0a1a 3:'CAZIP'
179 arcv 100 0:'ARCV' 5:01/02
180 red 100 0:52520129
183 hit 45 0:'UB' .hit
184 binary_ii 90 0:0a474c 18:02
185 tome 90 0:6b630001
186 os2pack 100 0:a596feff/a596ffff/a5960014/a596140a
187 os2pack2 100 0:a596fdff 24:'FTCOMP'
188 nufx 100 0:4ef546e96ce5
190 pmsfx 100 2:'-pms-'
202 squash 100 0:'SQSH'
204 lbr 100 0:0020202020202020202020200000
205 pack 65 0:1f1e
206 cas 70 0:'FUJI'
207 msa 45 0:0e0f
207 msa 100 0:0e0f .msa
208 pasti 100 0:'RSY' 3:00
248 packit 100 0:'PMag'/'PMa4'
248 packit 35 0:'PMa1'/'PMa2'/'PMa3'/'PMa5'/'PMa6'/'PMa7'
265 wad 80 0:'IWAD'/'PWAD'
266 crush 100 0:'CRUSH_v'
306 spacemaker 85 0:9c55568ccd83c5108db6
306 spacemaker 100 0:9c55568ccd83c5108db6 18:'MEMORY$'
314 lgcompress 80 0:dafa 8:0006
315 compress_lzh 10 0:1fa0
315 compress_lzh 90 0:1fa0 .z
317 npack 80 0:'MSTSM'
318 lzs221 80 0:'sTaC'
319 xpk 80 0:'XPKF'
323 zpk2 100 0:'zpk2'
325 cork 100 0:'CORK' 4:0100
328 aldus_inst 100 0:'ALDUS_PKZP_2.' 13:00
328 aldus_inst 100 0:'ALDUS_LZW_1.' 12:00
329 vort 100 0:'VORT01'
359 dosbackup33 100 0:8b 1:'BACKUP__'
364 apm 75 512:'PM' 514:0000 1024:'PM' 1026:0000
380 d64 100 91392:12014100 .d64
380 d64 30 .d64 len=174848|175531
402 bzip2 90 0:'BZh' 4:314159265359
402 7z 90 0:'7z' 2:bcaf271c
402 xz 90 0:fd377a585a00
402 lzip 50 0:'LZIP'
402 installshield_cab 40 0:'ISc('
402 stuffit_x 90 0:'StuffIt!'/'StuffIt?'
402 pack_ice 75 0:'ICE!'/'Ice!'
402 elf 40 0:7f 1:'ELF'
"""

# Images, animations and icons
IMAGES = """
0 jpeg 100 0:ffd8ff
1 tiff 100 0:'II*' 3:00
1 tiff 100 0:'MM' 2:002a
2 gif 100 0:'GIF87a'/'GIF89a'
4 psd 100 0:'8BPS'
5 png 100 0:89504e470d0a1a0a/8b4a4e470d0a1a0a/8a4d4e470d0a1a0a
9 jpeg2000 100 0:0000000c6a5020200d0a870a
17 ilbm 100 0:'FORM' 8:'ILBM'/'PBM_'/'ACBM'/'RGBN'/'RGB8'
19 eps 100 0:'%!PS-Adobe-' 14:'_EPSF-'
21 emf 100 0:01000000 40:'_EMF'
23 rgfx 100 0:'FORM' 8:'RGFX'
26 corel_ccx 100 0:'RIFF' 8:'CDRX'
27 mmm 100 0:'RIFF' 8:'RMMP'
28 sunras 100 0:59a66a95
32 bmff 80 4:'ftyp'
32 bmff 35 4:'mdat'/'moov'
32 bmff 10 4:'skip'/'wide'/'pnot'
32 bmff 9 4:'free'
33 j2c 100 0:ff4fff51
34 farbfeld 100 0:'farbfeld'
35 nie 100 0:6ec3af41/6ec3af45/6ec3af49
38 os2bmp 90 0:'BA' 14:'IC'/'PT'/'CI'/'CP'/'BM'
38 os2bmp 20 0:'CI'/'CP'/'PT'
38 os2bmp 10 0:'BA'/'IC'
60 anim 100 0:'FORM' 8:'ANIM'
61 deep 100 0:'FORM' 8:'DEEP'/'TVPP'
62 wv_brs 100 0:'NEO!' 8:'NEOP'
65 dcx 100 0:b168de3a
66 bpg 100 0:425047fb
71 msp 100 0:'DanM'/'LinS'
72 epocimage 100 0:3700001042000010/370000108a000010/370000106d0000107d000010/370000106a000010/37000010383a0010
73 psionpic 100 0:504943dc3030
77 bmi 100 0:'ZonerBMIa'
78 mrw 100 0:004d524d
85 ico 80 0:00000100/00000200
86 clp 15 0:50c3/51c3/52c3
86 clp 80 0:50c3/51c3/52c3 .clp
87 fli 20 4:11af/12af
87 fli 100 4:11af/12af .fli|flc
87 fli 9 5:af .fli|flc
92 amigaicon 90 0:e310
99 xbin 100 0:'XBIN' 4:1a
102 icedraw 100 0:04312e34
110 pgc 100 0:504701
111 pgx 90 0:'PGX'
119 flif 90 0:'FLIF'
121 nol 80 0:'NOL'
122 ngg 80 0:'NGG'
123 npm 80 0:'NPM'
124 nlm 80 0:'NLM_'
135 olpc565 100 0:'C565'
136 awbm 100 0:'AWBM'
137 lss16 100 0:3df31314
147 drhalopic 30 0:'AH' 6:02
147 drhalopic 70 0:'AH' 6:02 .pic
149 makichan 100 0:'MAKI0'
152 fastgraph_spr 90 0:46004100530054004700
154 crg 100 0:'CALAMUSCRG'
155 zbr 25 0:9a02
155 zbr 100 0:9a02 .zbr
156 cdr_wl 6 0:'WL'
156 cdr_wl 100 0:'WL' .cdr
158 corel_bmf 100 0:'@CorelBMF' 9:0a0d
159 animatic 100 48:27182818
160 iim 100 0:'IS_IMAGE'
161 deskmate_pnt 100 0:13504e54
173 pcxlib 100 0:'pcxLib' 6:00
193 bsave_cmpr 100 0:fd00b80000000000400200
196 autocad_slb 100 0:'AutoCAD_Slide_Library_1.0' 25:0d0a1a
198 grob 100 0:'HPHP48'/'HPHP49' 8:1e2b
198 grob 90 0:'GROB'
199 shg 50 0:6c50/6c70
201 prismpaint 100 0:'PNT' 3:00
209 vbm 80 0:'BM' 2:cb02/cb03
209 vbm 100 0:'BM' 2:cb02/cb03 .vbm
210 winzle 40 0:4f40
210 winzle 95 0:4f40 14:250d0d0d
217 hr 70 .hr len=19200
217 hr 30 .hr len>=19201 len<=19456
222 berts_bmg 100 0:0a0501015000 6:00007f02df018002e001 .bmg|ibg 64:000446000100 70:8002e001
233 pf_pgf 90 .pgf len=1920
234 qtif 20 .qtif
234 qtif 5 .qti|qif
235 degas 100 0:0000/0001/0002 .pi1|pi2|pi3|pc1|pc2|pc3 len=32034|32066
235 degas 40 0:00 .pi1|pi2|pi3|pc1|pc2|pc3 len=32128
235 degas 60 0:8000/8001/8002 .pi1|pi2|pi3|pc1|pc2|pc3
237 spectrum512u 90 .spu len=51104
237 spectrum512u 10 .spu len=51200
238 spectrum512s 100 0:53500000 .sps
239 spectrum512c 100 0:53500000 .spc
240 doodle 10 .doo len=32000
241 neochrome 100 .neo len=32128
241 neochrome 10 .neo len>=32129
242 neochrome_ani 100 0:babeebea
251 printmaster 10 0:0b3458
251 printmaster 90 0:0b3458 .sdr
251 printmaster 30 0:0b .sdr
253 pp_gph 100 0:'PrintPartner'
255 rodraw 49 0:'Draw'
255 rodraw 100 0:'Draw' 4:c900000000000000
267 eggpaint 80 0:'TRUP'
267 eggpaint 100 0:'tru?'
268 indypaint 70 0:'Indy'
269 godpaint 5 0:4734
269 godpaint 100 0:4734/0400 .god
270 ftc 60 .ftc len=184320
276 animator_pic 80 0:1991 10:0800
276 animator_pic 100 0:1991 10:0800 .pic|cel
277 young_picasso 75 0:500000500000520000
277 young_picasso 100 0:500000500000520000 .yp
278 iconmgr_ica 90 0:'ICM'/'IC2' 3:00
279 thumbsplus 95 0:bebadabe
280 fmtowns_icn 100 0:'ICNFILE' 7:00001a
280 fmtowns_icn 100 0:'CRI-FJ2_'/'CRI-FUJI'
281 fmtowns_hel 100 0:'he1' 3:0001000000
285 optiks_com 100 0:e939010d0a4f5054
286 dxp_image 100 0:'DXP1' 4:01
287 jgf5 100 0:'JGF5' 4:0000000003000000
290 mindjongg 100 0:05 1:'IPK01' 6:01000000
290 mindjongg 100 0:0500000049005000 8:4b003000330003000000
291 div_map 100 0:'map' 3:1a0d0a00
292 div_fpg 100 0:'fpg'/'f16' 3:1a0d0a00
294 imggal_alch 100 0:'ALCHGLRY'
295 gws_thn 100 0:'THNL'
309 cdi_imag 100 0:'FORM' 8:'IMAGIHDR'
310 storyboard 100 0:'EP_CAP'
311 adex 65 0:'PICT' 4:0004/0008/0104/0108
312 pkm 100 0:'PKM' 3:00
324 iconheaven 100 0:'LI' 2:000100000000
332 jovianvi 100 0:'VI' 2:10/11/20/21/22/23/30/31
333 vitec 100 0:005b0720
334 colorix 95 0:'RIX3' len>=36
336 fpaint_pi4 50 .pi4|pi9 len=77824
337 fpaint_pi9 60 .pi4|pi9 len=65024
338 atari_pi7 50 .pi7 len=308224
339 falcon_xga 50 .xga len=153600|368640
340 coke 100 0:'COKE_format.'
342 alphabmp 60 0:ffff/feff .bmp
343 syberia_syj 80 0:0001 .syj 8:0000ff -2:ffd9
344 esm_pix 100 0:'Esm_' 13:'PIX_' 21:ffd8
346 picjpeg 100 0:'BM' 14:44000000 30:'JPEG'
347 dib 15 0:28000000 12:01000100/01000400/01000800/01001000/01001800/01002000
353 pm_xv 15 0:'VIEW'/'WEIV'
355 megapaint_pat 40 0:07 1:'PAT'
355 megapaint_pat 100 0:07 1:'PAT' len=4396
356 megapaint_lib 40 0:07 1:'LIB'
356 megapaint_lib 100 0:07 1:'LIB' .lib
358 pss_ppm 39 0:'PX' 2:0a2320
402 raf 100 0:'FUJIFILMCCD-RAW'
402 autocad_slide 100 0:'AutoCAD_Slide' 13:0d0a1a
402 artworks 9 0:'Top!'
402 photo_paint 91 0:'CPT7FILE'/'CPT8FILE'/'CPT9FILE'
"""

# Sounds, fonts, texts and data of programs
OTHERS = """
13 asf 100 0:3026b2758e66cf11a6d900aa0062ce6c
14 ebml 100 0:1a45dfa3
22 midi 100 0:'MThd'
39 id3 90 0:'ID3'
40 ogg 100 0:'OggS'
41 flac 100 0:'fLaC'
43 monkeys_audio 100 0:'MAC_'
44 rm 100 0:'.RMF' 4:00
48 wpg 100 0:ff575043
64 jbf 100 0:'JASC_BROWS_FILE'
74 psionapp 100 0:'ImageFileType**'/'OPLObjectFile**' 15:00
76 dsstore 100 0:00000001 4:'Bud1'
98 sauce 2 -128:'SAUCE00'
105 ldog_com 100 0:06b40fcd103c077406b800b8eb0490b8 len<=65280
108 hsiraw 100 0:'mhwanh'
113 uuencode 100 0:'begin-base64_'
120 psf 100 0:72b54a86
127 amos_source 80 0:'AMOS_Basic'/'AMOS_Pro'
127 amos_source 100 0:'AMOS_Basic'/'AMOS_Pro' .amos
132 stos 100 0:19861987
132 stos 99 0:'Lionpoubnk'
133 pff2 100 0:46494c450000000450464632
134 tivariable 10 0:'**TI'
134 tivariable 100 0:'**TI73**'/'**TI82**'/'**TI83**'/'**TI83F*'/'**TI85**'/'**TI86**'/'**TI89**'/'**TI92**'/'**TI92P*'
140 cardfile 80 0:'MGC'
197 plist 100 0:'bplist00'
211 fontmania 100 0:eb 8:'FONT_MANIA,_V' len<=65280
212 pcrfont 80 0:'KPG'
214 evafont 100 0:e9 7:'_font_driver_v' len<=65280
214 evafont 100 0:e9 11:'_font_loader_v' len<=65280
215 cpi 100 0:ff464f4e54202020/ff464f4e542e4e54/7f4452464f4e5420
218 applevol 20 0:01 3:000c
219 basic_c64 20 0:0108 .prg
223 ps_gradient 90 0:'8BGR'
223 ps_gradient 100 0:'8BGR' .grd
224 ps_styles 90 2:'8BSL'
224 ps_styles 100 2:'8BSL' .asl
225 ps_action 100 0:000000100000 .atn
225 ps_action 5 0:0000000c .atn
226 ps_brush 80 0:0001/0002/0006/0007 .abr
227 ps_csh 80 0:'cush'
227 ps_csh 100 0:'cush' .csh
228 ps_pattern 90 0:'8BPT'
228 ps_pattern 100 0:'8BPT' .pat
229 rsc 70 0:0000/0001/0004 .rsc
230 gemmeta 100 0:ffff1800
231 pcf 100 0:01666370
243 iccprofile 80 36:'acsp'
259 desqview_dvp 40 0:00 .dvp len=416
271 pkfont 75 0:f759
293 mmfw 100 0:'MMFW_'
298 makeread 89 0:e9930000 27:'Press_Home_P' len<=65280
298 makeread 89 0:e9070100 19:'Press_Home_P' len<=65280
298 makeread 89 0:e90c0100 19:'<_H=Home' len<=65280
299 gtxt 100 0:bbbc01b402b1008a 95:7301c32c40c3cd20 len<=65280
303 ascom 100 0:e90000e800008bfc368b2d83c40281ed len<=65280
341 videomaster 100 0:'VMAS1'
367 reko 70 0:'REKO' 8:00
367 reko 70 0:'PCREKOD_'
367 reko 70 0:'PCREKO' 6:0000
367 reko 70 0:'PCRKP' 5:00
368 wizsolitaire 100 0:'WizSolitaireDeck'
402 pdf 90 0:'%PDF-'
402 xmp 20 0:'<?xpacket'
402 voc 90 0:'Creative_Voice_File' 19:1a
402 word_perfect 40 0:ff575043
402 hp48 90 0:'HPHP48'/'HPHP49'
402 html 20 0:'<!DOCTYPE_html'
402 html 20 0:efbbbf 3:'<!DOCTYPE_html'
402 html 20 0:'<html'
"""
